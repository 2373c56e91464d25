"""Normalising labels that a model writes loosely."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duecall.functions.values import Field
from duecall.vocabulary import CALL_LABELS, PAYMENT_LABELS


def label_text(field: Field, when_missing: str) -> Column:
    """Upper-cased with underscores; an explicit null reads as the word NONE."""
    text = (
        F.when(field.missing, F.lit(when_missing))
        .when(field.null, F.lit("None"))
        .otherwise(field.text)
    )
    return F.replace(F.upper(text), F.lit(" "), F.lit("_"))


def normalise_call_label(label: Column) -> Column:
    """Known label, else the nearest family, else any plain word longer than two characters."""
    plain_word = (F.length(label) > 2) & F.replace(label, F.lit("_"), F.lit("")).rlike(
        r"^[\p{L}\p{N}]+\z"
    )
    return (
        F.when(label.isin(CALL_LABELS), label)
        .when(label.contains("FAMILY"), F.lit("ANSWERED_BY_FAMILY_MEMBER"))
        .when(label.contains("BUSY"), F.lit("BUSY"))
        .when(label.contains("WRONG"), F.lit("WRONG_NUMBER"))
        .when(label.contains("ANSWER"), F.lit("ANSWERED"))
        .when(plain_word, label)
        .otherwise(F.lit("OTHERS"))
    )


def normalise_payment_label(label: Column) -> Column:
    return (
        F.when(label.isin(PAYMENT_LABELS), label)
        .when(label.contains("CLAIM"), F.lit("PAID"))
        .when(label.contains("PROMISE") | label.contains("PTP"), F.lit("PTP"))
        .when(label.contains("REFUSE") | label.contains("DENY"), F.lit("DENIED_TO_PAY"))
        .otherwise(F.lit("None"))
    )


def map_reason(reason: Column) -> Column:
    """Job loss becomes its label; every other reason stays as written, null included."""
    job_loss = F.upper(reason).contains("JOB") & F.upper(reason).contains("LOSS")
    return F.when(job_loss, F.lit("JOB_CHANGED_WAITING_FOR_SALARY")).otherwise(reason)
