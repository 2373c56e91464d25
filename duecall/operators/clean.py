"""From a parsed answer to the six response fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecall.functions import labels, policy, promise
from duecall.functions.fence import fenced
from duecall.functions.values import Field, read_fields, whole_number_text
from duecall.vocabulary import BAD_REMARKS, RESPONSE_FIELDS

_INPUT_ERRORS = ["request_error", "generate_error", "parse_error"]


def normalise_labels(df: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """Adds ``_call``, ``_pay`` and ``_reason``."""
    return df.withColumns(
        {
            "__call": labels.label_text(fields["disposition"], "OTHERS"),
            "__pay": labels.label_text(fields["payment_disposition"], "None"),
            "__reason": labels.map_reason(fields["reason_for_not_paying"].text),
        }
    ).withColumns(
        {
            "__call": labels.normalise_call_label(F.col("__call")),
            "__pay": labels.normalise_payment_label(F.col("__pay")),
        }
    )


def settle_amount(df: DataFrame, amount: Field, transcript: str, wanted: Column) -> DataFrame:
    """Adds ``_amount`` where ``wanted``: a truthy amount must be grounded, a falsy one stays."""
    return (
        df.withColumn("__number", F.when(wanted, promise.amount_number(amount.text)))
        .withColumn("__whole", whole_number_text(F.col("__number")))
        .withColumn(
            "__amount",
            F.when(
                wanted,
                F.when(
                    amount.truthy, promise.ground_amount(F.col("__whole"), F.col(transcript))
                ).otherwise(amount.text),
            ),
        )
        .drop("__number", "__whole")
    )


def settle_date(df: DataFrame, date: Field, current_date: str, wanted: Column) -> DataFrame:
    """Adds ``_date`` where ``wanted``; needs ``_spoken``, the transcript in lower case.

    Without a date or without a reference there is nothing to resolve.
    """
    today = F.col(current_date)
    resolved = (
        df.withColumn("__reference", F.when(wanted, promise.reference_date(today)))
        .withColumn(
            "__said",
            promise.resolve_relative_date(date.text, F.col("__spoken"), F.col("__reference"), today),
        )
        .withColumn("__iso", promise.extract_iso_date(F.col("__said")))
        .withColumn("__month_end", promise.month_end(F.col("__iso")))
    )
    checked = F.when(
        F.col("__reference").isNotNull(),
        promise.cap_month_end(F.col("__iso"), F.col("__month_end")),
    )
    applies = date.truthy & (F.coalesce(today, F.lit("")) != "")
    return resolved.withColumn(
        "__date", F.when(wanted, F.when(applies, checked).otherwise(date.text))
    ).drop("__reference", "__said", "__iso", "__month_end")


ANSWER_PATHS = {
    "disposition": "$.disposition",
    "payment_disposition": "$.payment_disposition",
    "reason_for_not_paying": "$.reason_for_not_paying",
    "amount": "$.ptp_details.amount",
    "date": "$.ptp_details.date",
    "remarks": "$.remarks",
    "confidence_score": "$.confidence_score",
    "error": "$.error",
}


def clean_answers(
    df: DataFrame,
    answer: str = "answer",
    transcript: str = "transcript",
    current_date: str = "current_date",
    raw: str = "generation",
    keep_extra: bool = False,
) -> DataFrame:
    """Adds the response fields, ``error``, ``raw`` and ``failed``; consumes the answer.

    Errors of earlier steps (``request_error``, ``generate_error``, ``parse_error``), where
    present, become the row's ``error``. With ``keep_extra`` the keys the response does not know
    stay in the map ``extra`` as JSON text. All of it is narrow: no shuffle. The rules run in
    steps so that a value several rules need is a column, computed once per row.
    """
    read, fields = read_fields(df, answer, ANSWER_PATHS)

    # The label decides whether promise details exist, so the work on them waits for it.
    labelled = normalise_labels(read, fields).withColumn(
        "__promise", promise.is_promise(F.col("__pay"))
    )
    wanted = F.col("__promise")
    spoken = labelled.withColumns(
        {
            "__spoken": F.when(wanted, F.lower(F.col(transcript))),
            "__confidence": policy.confidence_number(fields["confidence_score"]),
            "__noted": policy.downgraded_remarks(fields["remarks"]),
        }
    )
    # The fences keep each part of the generated code small enough for the JVM to compile.
    parts = ["__call", "__pay", "__reason", "__promise", "__spoken", "__noted", "__confidence"]
    parts += [f"__{f}_{p}" for f in ("amount", "date", "remarks", "error") for p in ("kind", "text")]
    labelled = fenced(spoken, df.columns, {name: F.col(name) for name in parts})
    settled = settle_amount(labelled, fields["amount"], transcript, wanted)
    settled = settle_date(settled, fields["date"], current_date, wanted)
    facts = ["__call", "__pay", "__reason", "__spoken", "__amount", "__date", "__noted", "__confidence"]
    facts += [f"__{name}_{part}" for name in ("remarks", "error") for part in ("kind", "text")]
    settled = fenced(settled, df.columns, {name: F.col(name) for name in facts})

    earlier = [F.col(name) for name in _INPUT_ERRORS if name in df.columns]
    judged = settled.withColumn(
        "__vague",
        policy.is_vague_promise(
            F.col("__pay"), F.col("__spoken"), F.col("__amount"), F.col("__date")
        ),
    ).withColumn(
        "__problem",
        F.coalesce(*earlier, F.when(F.col("__vague") & F.col("__noted").isNull(), F.lit(BAD_REMARKS))),
    )

    fine, vague = F.col("__problem").isNull(), F.col("__vague")
    response = {
        "disposition": F.col("__call"),
        "payment_disposition": F.when(vague, F.lit("NO_PAYMENT_COMMITMENT")).otherwise(
            F.col("__pay")
        ),
        "reason_for_not_paying": F.col("__reason"),
        "ptp_details": F.struct(F.col("__amount").alias("amount"), F.col("__date").alias("date")),
        "remarks": F.when(vague, F.col("__noted")).otherwise(fields["remarks"].text),
        "confidence_score": policy.clamp_confidence(F.col("__confidence")),
    }
    outcome = {name: F.when(fine, value) for name, value in response.items()}
    outcome["error"] = F.coalesce(F.col("__problem"), fields["error"].text)
    outcome["raw"] = F.when(~fine, F.col(raw))
    outcome["failed"] = ~fine | ~fields["error"].missing
    if keep_extra:
        outcome["extra"] = F.when(fine, _unknown_keys(answer))
    dropped = {answer, *_INPUT_ERRORS, *outcome}
    return fenced(judged, [name for name in df.columns if name not in dropped], outcome)


def _unknown_keys(answer: str) -> Column:
    members = F.try_variant_get(F.col(answer), "$", "map<string,variant>")
    unknown = F.map_filter(members, lambda key, _: ~key.isin(RESPONSE_FIELDS))
    return F.transform_values(unknown, lambda _, value: F.to_json(value))
