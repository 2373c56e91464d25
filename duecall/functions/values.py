"""Reading loosely typed values out of a VARIANT answer.

A key can be absent, null, or hold a value that counts as false; the cleaning rules treat the
three differently. ``read_fields`` turns each key into a few plain columns once, so that the
rules refer to columns and their expressions stay small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecall.functions.fence import fenced


@dataclass(frozen=True)
class Field:
    """Columns ``read_fields`` made for one key."""

    name: str

    @property
    def kind(self) -> Column:
        """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, ARRAY, OBJECT or VOID; null when absent."""
        return F.col(f"__{self.name}_kind")

    @property
    def missing(self) -> Column:
        return self.kind.isNull()

    @property
    def null(self) -> Column:
        return self.kind == "VOID"

    @property
    def text(self) -> Column:
        """Text form; null for absent and null. A fractional literal keeps its point (``7.0``)."""
        return F.col(f"__{self.name}_text")

    @property
    def truthy(self) -> Column:
        return F.coalesce(
            F.when(self.kind == "STRING", self.text != "")
            .when(self.kind.isin("BIGINT", "DECIMAL", "DOUBLE"), self.text.try_cast("double") != 0)
            .otherwise(~self.text.isin("false", "{}", "[]")),
            F.lit(False),
        )


def read_fields(
    df: DataFrame, answer: str, paths: dict[str, str]
) -> tuple[DataFrame, dict[str, Field]]:
    """Adds the columns of every key; SQL text keeps the many small expressions cheap to build.

    They are fenced also because the code generated for reading and for the rules would otherwise
    land in one method too large for the JVM to compile.
    """
    values = [
        f"try_variant_get({answer}, '{path}', 'variant') AS __{name}_value"
        for name, path in paths.items()
    ]
    kinds = [
        f"regexp_extract(schema_of_variant(__{name}_value), '^[A-Z]+', 0) AS __{name}_kind"
        for name in paths
    ]
    plain = [f"try_variant_get(__{name}_value, '$', 'string') AS __{name}_plain" for name in paths]
    read = df.selectExpr("*", *values).selectExpr("*", *kinds, *plain)
    columns = {}
    for name in paths:
        columns[f"__{name}_kind"] = F.col(f"__{name}_kind")
        columns[f"__{name}_text"] = F.expr(
            f"CASE WHEN __{name}_kind = 'DECIMAL' AND __{name}_plain RLIKE '^-?[0-9]{{1,18}}$' "
            f"THEN concat(__{name}_plain, '.0') ELSE __{name}_plain END"
        )
    return fenced(read, df.columns, columns), {name: Field(name) for name in paths}


# First code point of the ten decimal digits of each script a transcript or an answer may use:
# Devanagari, Bengali, Gurmukhi, Gujarati, Tamil, Telugu, Kannada, Malayalam.
_DIGIT_ZEROS = [0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66]


def ascii_digits(text: Column) -> Column:
    return F.translate(
        text,
        "".join(chr(zero + i) for zero in _DIGIT_ZEROS for i in range(10)),
        "0123456789" * len(_DIGIT_ZEROS),
    )


_DIGITS = "[0-9](?:_?[0-9])*"
_NUMBER = rf"(?U)^\s*([+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?)\s*\z"


def parse_number(text: Column) -> Column:
    """Floating-point value of a number written as text, null for anything else."""
    digits = F.regexp_extract(ascii_digits(text), _NUMBER, 1)
    return F.replace(digits, F.lit("_"), F.lit("")).try_cast("double")


def whole_number_text(number: Column) -> Column:
    """Number cut toward zero, as text; null when it has no finite value."""
    return F.coalesce(
        number.try_cast("bigint").cast("string"), number.try_cast("decimal(38,0)").cast("string")
    )


def contains_any(text: Column, words: list[str]) -> Column:
    """True where any of the plain words occurs, also inside a longer word."""
    return text.rlike("|".join(words))
