"""Label reports over (gold, predicted) columns.

Every report starts from confusion counts, which are combined before the shuffle: a label that
holds most rows costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_validity_rate(parsed: DataFrame) -> DataFrame:
    """Answers that parsed, over all answers, in percent."""
    total, errors = F.count(F.lit(1)), F.count_if(F.col("parse_error").isNotNull())
    return parsed.agg(
        total.alias("total"),
        errors.alias("errors"),
        (F.try_divide(total - errors, total) * 100).alias("validity_rate"),
    )


def strict_accuracy(aligned: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Percent of *valid* rows with an equal label; failed rows leave the denominator."""
    valid = aligned.where(~F.col("failed"))
    hit = F.col(gold).eqNullSafe(F.col(predicted))
    return valid.agg(
        F.count(F.lit(1)).alias("valid"), (F.avg(hit.cast("double")) * 100).alias("accuracy")
    )


def confusion(aligned: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Counts per (gold, predicted) pair of the valid rows."""
    return (
        aligned.where(~F.col("failed"))
        .groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted"))
        .agg(F.count(F.lit(1)).alias("pairs"))
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def classification_report(confused: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; a measure without a denominator is 0.

    Each confusion pair adds to the row of its gold label and to the row of its predicted label,
    so one more small aggregation gives both totals without a join.
    """
    zero, pairs = F.lit(0).cast("bigint"), F.col("pairs")
    sides = F.array(
        F.struct(
            F.col("gold").alias("label"),
            pairs.alias("support"),
            zero.alias("predictions"),
            F.when(F.col("gold").eqNullSafe(F.col("predicted")), pairs).otherwise(zero).alias("hits"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            zero.alias("support"),
            pairs.alias("predictions"),
            zero.alias("hits"),
        ),
    )
    totals = (
        confused.select(F.explode(sides).alias("side"))
        .groupBy("side.label")
        .agg(*[F.sum(f"side.{name}").alias(name) for name in ("support", "predictions", "hits")])
    )
    measured = totals.withColumns(
        {
            "precision": _ratio(F.col("hits"), F.col("predictions")),
            "recall": _ratio(F.col("hits"), F.col("support")),
            # the harmonic mean of the two, written over the counts
            "f1": _ratio(2 * F.col("hits"), F.col("predictions") + F.col("support")),
        }
    )
    return measured.select("label", "precision", "recall", "f1", "support", "hits")


def report_averages(report: DataFrame) -> DataFrame:
    """Accuracy, macro mean and support-weighted mean of a classification report."""
    support = F.sum("support")
    averages = [F.try_divide(F.sum("hits"), support).alias("accuracy")]
    for measure in ("precision", "recall", "f1"):
        averages.append(F.avg(measure).alias(f"macro_{measure}"))
        averages.append(
            F.try_divide(F.sum(F.col(measure) * F.col("support")), support).alias(
                f"weighted_{measure}"
            )
        )
    return report.agg(*averages, support.alias("support"))


def top_confusions(confused: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent wrong pairs, equal counts in label order."""
    return (
        confused.where(~F.col("gold").eqNullSafe(F.col("predicted")))
        .orderBy(F.desc("pairs"), "gold", "predicted")
        .limit(k)
    )


def ptp_kpis(matched: DataFrame) -> DataFrame:
    """Promise measures over the gold promises: right amount, right date, promise recognised."""
    promised = F.col("expected_payment_disposition") == "PTP"
    valid = promised & ~F.col("failed")

    def share(hit: Column) -> Column:
        return F.try_divide(F.count_if(hit), F.count_if(promised)) * 100

    return matched.agg(
        F.count_if(promised).alias("gold_promises"),
        share(valid & F.col("match_amount")).alias("amount_accuracy"),
        share(valid & F.col("ptp_details.date").eqNullSafe(F.col("expected_date"))).alias(
            "date_accuracy"
        ),
        share(valid & (F.col("payment_disposition") == "PTP")).alias("ptp_recall"),
    )
