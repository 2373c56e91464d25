"""Downgrading vague promises, and the confidence score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duecall.functions.values import Field, contains_any, parse_number
from duecall.vocabulary import (
    COMMITMENT_WORDS,
    DEFAULT_CONFIDENCE,
    DOWNGRADE_NOTE,
    VAGUE_WORDS,
)


def is_vague_promise(payment_label: Column, spoken: Column, amount: Column, date: Column) -> Column:
    """A bare PTP whose lower-cased transcript only says that the borrower will think about it."""
    return F.coalesce(
        (payment_label == "PTP")
        & amount.isNull()
        & date.isNull()
        & contains_any(spoken, VAGUE_WORDS)
        & ~contains_any(spoken, COMMITMENT_WORDS),
        F.lit(False),
    )


def downgraded_remarks(remarks: Field) -> Column:
    """Remarks with the note; null when the remarks are present but not text."""
    return F.when(remarks.missing, F.lit(DOWNGRADE_NOTE)).when(
        remarks.kind == "STRING", F.concat(remarks.text, F.lit(DOWNGRADE_NOTE))
    )


_UNBOUNDED = r"(?iU)^\s*[+]?(?:inf|infinity)\s*\z"
_NEGATIVE_UNBOUNDED = r"(?iU)^\s*-(?:inf|infinity)\s*\z"
_NOT_A_NUMBER = r"(?iU)^\s*[+-]?nan\s*\z"


def confidence_number(confidence: Field) -> Column:
    text = confidence.text
    return F.coalesce(
        F.when(confidence.kind == "BOOLEAN", (text == "true").cast("double")),
        parse_number(text),
        F.when(text.rlike(_NOT_A_NUMBER), F.lit(float("nan")))
        .when(text.rlike(_UNBOUNDED), F.lit(1.0))
        .when(text.rlike(_NEGATIVE_UNBOUNDED), F.lit(0.0)),
        F.lit(DEFAULT_CONFIDENCE),
    )


def clamp_confidence(number: Column) -> Column:
    """Number within [0, 1]; NaN stays NaN."""
    return F.when(F.isnan(number), number).otherwise(
        F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))
    )
