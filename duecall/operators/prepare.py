"""From an input row to a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecall.vocabulary import (
    EMPTY_TRANSCRIPT,
    MAX_TRANSCRIPT_CHARS,
    PROMPT_PAYMENT_LABELS,
    PROMPT_REASONS,
    TRUNCATION_MARK,
)

INSTRUCTION = (
    "Read a loan-collection call and report its outcome as one JSON object.\n"
    "Keys: disposition, payment_disposition, reason_for_not_paying, ptp_details, remarks, "
    "confidence_score. ptp_details holds amount and date.\n"
    f"payment_disposition is one of: {', '.join(PROMPT_PAYMENT_LABELS)}.\n"
    f"reason_for_not_paying is one of: {', '.join(PROMPT_REASONS)}.\n"
    "Use PTP only when a sum and a day are named; otherwise use NO_PAYMENT_COMMITMENT.\n"
    "A refusal or an inability to pay is DENIED_TO_PAY, with its reason.\n"
    "Write dates as YYYY-MM-DD; 'kal' is the next day, 'parso' the day after that.\n"
    "confidence_score lies between 0 and 1. Answer with the JSON object only."
)


# Stands before the transcript in a prompt.
SAID = "What was said:"


def unwrap_transcript(df: DataFrame, column: str) -> Column:
    """Text of a transcript column.

    A record yields its ``transcript`` field, else its JSON text; a JSON object held in a string
    column counts as a record. Any other type is cast to text.
    """
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        record = F.when(F.ltrim(value).startswith("{"), F.try_parse_json(value))
    elif isinstance(kind, (T.StructType, T.MapType)):
        value = F.to_json(value)
        record = F.try_parse_json(value)
    elif isinstance(kind, T.VariantType):
        record, value = value, F.try_variant_get(value, "$", "string")
    else:
        return value.cast("string")
    return F.coalesce(F.try_variant_get(record, "$.transcript", "string"), value)


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "") == "")


def reject_blank(df: DataFrame, column: str = "transcript") -> DataFrame:
    """Adds ``request_error`` for rows without any text; they stay in the result."""
    return df.withColumn("request_error", F.when(is_blank(F.col(column)), F.lit(EMPTY_TRANSCRIPT)))


def default_current_date(current_date: Column, run_date: str) -> Column:
    """Null or empty takes the run date, a parameter so that reruns agree."""
    return F.coalesce(F.nullif(current_date, F.lit("")), F.lit(run_date))


def truncate_transcript(text: Column, limit: int = MAX_TRANSCRIPT_CHARS) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(TRUNCATION_MARK))
    ).otherwise(text)


def render_prompt(
    transcript: Column, current_date: Column, instruction: str = INSTRUCTION
) -> Column:
    return F.concat(
        F.lit(f"{instruction}\n\nThe call took place on "),
        current_date,
        F.lit(f".\n{SAID}\n"),
        transcript,
        F.lit("\n\nJSON object:\n"),
    )


def prepare_requests(
    df: DataFrame,
    transcript: str,
    run_date: str,
    current_date: str | None = None,
    instruction: str = INSTRUCTION,
    limit: int = MAX_TRANSCRIPT_CHARS,
) -> DataFrame:
    """Adds ``_original_transcript``, ``transcript``, ``truncated``, ``current_date``,
    ``request_error``, ``prompt``.

    Transcripts are cut after ``limit`` characters, and ``truncated`` tells which; the rules on
    amounts and dates then see the cut text too. Rows without text get a null prompt, which keeps them away from the generator.
    """
    given = F.col(current_date) if current_date else F.lit(None).cast("string")
    reference = default_current_date(given, run_date)
    rows = df.withColumn("_original_transcript", F.col(f"`{transcript}`")).withColumns(
        {
            "transcript": truncate_transcript(F.col("_original_transcript"), limit),
            "truncated": F.coalesce(F.length("_original_transcript") > limit, F.lit(False)),
            "current_date": reference,
        }
    )
    return reject_blank(rows).withColumn(
        "prompt",
        F.when(
            F.col("request_error").isNull(),
            render_prompt(F.col("transcript"), F.col("current_date"), instruction),
        ),
    )
