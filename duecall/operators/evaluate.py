"""Comparing predictions with gold records.

A prediction column is called as in the response; a gold column carries the prefix ``expected_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ["disposition", "payment", "reason", "amount", "date"]
_EXPECTED = {
    "disposition": "expected_disposition",
    "payment": "expected_payment_disposition",
    "reason": "expected_reason_for_not_paying",
    "amount": "expected_amount",
    "date": "expected_date",
}
_PREDICTED = {
    "disposition": "disposition",
    "payment": "payment_disposition",
    "reason": "reason_for_not_paying",
    "amount": "ptp_details.amount",
    "date": "ptp_details.date",
}
_LENIENT_PAYMENTS = ["PTP", "PARTIAL_PAYMENT"]


def align_gold(gold: DataFrame, predictions: DataFrame, on: str | list[str]) -> DataFrame:
    """Every gold row with its prediction; ``failed`` is true where there is none.

    An equi-join on the record key, one prediction per key. Left unhinted: the optimizer
    broadcasts a side only below its size threshold and splits skewed partitions otherwise.
    Predictions made from the gold rows themselves already carry the gold columns and need no join.
    """
    joined = gold.join(predictions, on, "left")
    return joined.withColumn("failed", F.coalesce(F.col("failed"), F.lit(True)))


def _or_none_word(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def match_fields(aligned: DataFrame) -> DataFrame:
    """Adds ``match_<measure>`` and ``exact_match``; a failed prediction matches nothing.

    Call label: equal. Payment: equal, or both a (partial) promise. Reason and amount: equal,
    where null and the word None agree. Date: present on both sides or on neither.
    """
    gold = {measure: F.col(column) for measure, column in _EXPECTED.items()}
    pred = {measure: F.col(column) for measure, column in _PREDICTED.items()}
    rules = {
        "disposition": pred["disposition"].eqNullSafe(gold["disposition"]),
        "payment": pred["payment"].eqNullSafe(gold["payment"])
        | (
            F.coalesce(pred["payment"].isin(_LENIENT_PAYMENTS), F.lit(False))
            & F.coalesce(gold["payment"].isin(_LENIENT_PAYMENTS), F.lit(False))
        ),
        "reason": _or_none_word(pred["reason"]) == _or_none_word(gold["reason"]),
        "amount": _or_none_word(pred["amount"]) == _or_none_word(gold["amount"]),
        "date": (pred["date"].isNull() == gold["date"].isNull())
        | ((_or_none_word(pred["date"]) == "None") & (_or_none_word(gold["date"]) == "None")),
    }
    matched = aligned.withColumns(
        {f"match_{measure}": ~F.col("failed") & rule for measure, rule in rules.items()}
    )
    return matched.withColumn("exact_match", exact_match())


def exact_match() -> Column:
    result = F.lit(True)
    for measure in MEASURES:
        result = result & F.col(f"match_{measure}")
    return result


def accuracy(matched: DataFrame, by: str = "language") -> DataFrame:
    """Percent of *all* gold rows that match, per group; failed rows stay in the denominator."""
    total = F.count(F.lit(1))
    return matched.groupBy(by).agg(
        total.alias("total"),
        *[
            (F.count_if(F.col(f"match_{measure}")) / total * 100).alias(measure)
            for measure in MEASURES
        ],
    )


def overall_accuracy(accuracies: DataFrame, by: str = "language") -> DataFrame:
    """Adds the unweighted mean of the five accuracies; the weakest group comes first."""
    summed = F.col(MEASURES[0])
    for measure in MEASURES[1:]:
        summed = summed + F.col(measure)
    return accuracies.withColumn("overall", summed / len(MEASURES)).orderBy("overall", by)


def format_report(accuracies: DataFrame, by: str = "language") -> DataFrame:
    """One table line per group: capitalised name and whole percents, ties to even."""
    name = F.concat(F.upper(F.substring(by, 1, 1)), F.lower(F.expr(f"substring({by}, 2)")))
    percents = [F.bround(F.col(column), 0) for column in [*MEASURES, "overall"]]
    line = "%-10s" + " | %5.0f%%" * len(percents)
    return overall_accuracy(accuracies, by).select(
        by, F.format_string(line, name, *percents).alias("line")
    )


def mismatch_report(matched: DataFrame, *keys: str) -> DataFrame:
    """Answered rows with any miss: start of the transcript, expected and predicted where missed."""

    def pair(label: str, missed: Column, measures: list[str]) -> Column:
        def joined(columns: dict[str, str]) -> Column:
            return F.concat_ws(", ", *[_or_none_word(F.col(columns[m])) for m in measures])

        return F.when(
            missed,
            F.struct(
                F.lit(label).alias("field"),
                joined(_EXPECTED).alias("expected"),
                joined(_PREDICTED).alias("predicted"),
            ),
        )

    def missed(*measures: str) -> Column:
        result = F.lit(False)
        for measure in measures:
            result = result | ~F.col(f"match_{measure}")
        return result

    misses = F.array_compact(
        F.array(
            pair("labels", missed("disposition", "payment"), ["disposition", "payment"]),
            pair("reason", missed("reason"), ["reason"]),
            pair("promise", missed("amount", "date"), ["amount", "date"]),
        )
    )
    return matched.where(~F.col("failed") & ~F.col("exact_match")).select(
        *keys,
        F.concat(F.substring("transcript", 1, 50), F.lit("...")).alias("transcript_start"),
        misses.alias("misses"),
    )


def eval_pairs(matched: DataFrame, *keys: str) -> DataFrame:
    """Gold and predicted values side by side for every answered row."""

    def side(columns: dict[str, str]) -> Column:
        names = dict(zip(MEASURES, ["disp", "pay", "reason", "amt", "date"], strict=True))
        return F.struct(
            *[F.col(column).cast("string").alias(names[m]) for m, column in columns.items()]
        )

    return matched.where(~F.col("failed")).select(
        *keys,
        "transcript",
        side(_EXPECTED).alias("gold"),
        side(_PREDICTED).alias("predicted"),
        F.col("exact_match").alias("is_exact_match"),
        "remarks",
    )
