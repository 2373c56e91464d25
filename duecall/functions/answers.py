"""Finding and parsing the JSON object inside generated text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def slice_json(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty when no ``}`` follows; null without ``{``."""
    start = F.instr(text, "{")
    end = F.length(text) - F.length(F.substring_index(text, "}", -1))
    return F.when(start > 0, F.substring(text, start, end - start + 1))


# Bare tokens that count as numbers in the answers although JSON has no such literals.
_BARE_NUMBER = r"([:\[,]\s*)(-?)(NaN|Infinity)(?=\s*[,}\]])"


# A whole string, what lies between strings, or a quote that nothing closes.
_TOKEN = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|[^"]++|"'


def _outside_strings(text: Column, change: Callable[[Column], Column]) -> Column:
    """``change`` made on the parts of a JSON text that lie outside its strings; one pass cuts the
    text, and strings stay as they are, whatever characters they hold."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    kept = F.transform(tokens, lambda t: F.when(t.startswith('"'), t).otherwise(change(t)))
    return F.array_join(kept, "")


def _parse(text: Column, before: str, after: str) -> Column:
    """VARIANT of the text between the two literals; bare number words are read as their text."""
    worded = _outside_strings(
        text,
        lambda part: F.regexp_replace(
            F.regexp_replace(part, _BARE_NUMBER, '$1"$2$3"'), '"(-?)Infinity"', '"$1inf"'
        ),
    )
    return F.coalesce(
        F.try_parse_json(F.concat(F.lit(before), text, F.lit(after))),
        F.when(
            text.rlike(_BARE_NUMBER),
            F.try_parse_json(F.concat(F.lit(before), worded, F.lit(after))),
        ),
    )


def parse_in_brackets(sliced: Column) -> Column:
    """VARIANT array of the sliced text; the first half of a strict parse."""
    return F.when(sliced.startswith("{"), _parse(sliced, "[", "]"))


def only_object(array: Column, sliced: Column) -> Column:
    """The object of ``parse_in_brackets`` when nothing follows it, else null.

    The parser stops after the first value and ignores what follows. Inside brackets, trailing
    data turns into a second element or into a syntax error, except for text that closes the
    bracket itself; such text cannot also be the value of a key, and only then that is tried.
    """
    closes_bracket = sliced.rlike(r"\}\s*\]")
    return F.when(
        F.try_variant_get(array, "$[1]", "variant").isNull()
        & (~closes_bracket | _parse(sliced, '{"answer":', "}").isNotNull()),
        F.try_variant_get(array, "$[0]", "variant"),
    )
