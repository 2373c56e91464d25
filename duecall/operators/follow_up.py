"""Uses of the extracted outcomes: audit, reminders, more promise examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_agent_labels(
    agent: DataFrame, cleaned: DataFrame, on: str, agent_label: str = "agent_disposition"
) -> DataFrame:
    """Calls whose label by the agent differs from the extracted one (failed rows differ not)."""
    extracted = cleaned.where(~F.col("failed")).select(
        on, "disposition", "payment_disposition", "ptp_details", "confidence_score"
    )
    return agent.join(extracted, on).where(~F.col(agent_label).eqNullSafe(F.col("disposition")))


def promises(cleaned: DataFrame) -> DataFrame:
    """Promises that name a real day, with typed ``ptp_date`` and ``ptp_amount`` beside the text."""
    return (
        cleaned.where(~F.col("failed") & (F.col("payment_disposition") == "PTP"))
        .withColumns(
            {
                "ptp_date": F.try_to_date("ptp_details.date", "yyyy-MM-dd"),
                "ptp_amount": F.col("ptp_details.amount").try_cast("decimal(38,2)"),
            }
        )
        .where(F.col("ptp_date").isNotNull())
    )


def payment_reminders(promised: DataFrame) -> DataFrame:
    """Reminders due per day: how many promises, how many name an amount, and their sum."""
    return promised.groupBy("ptp_date").agg(
        F.count(F.lit(1)).alias("promises"),
        F.count("ptp_amount").alias("with_amount"),
        F.sum("ptp_amount").alias("amount_due"),
    )


def oversample_keywords(
    df: DataFrame, text: str, keywords: list[str], copies: int
) -> DataFrame:
    """Rows whose text holds any keyword ``copies`` times, the others once; ``copy_no`` from 1."""
    pattern = "|".join(rf"\Q{word}\E" for word in keywords)
    times = F.when(F.lower(F.col(text)).rlike(pattern), copies).otherwise(1)
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(1), times)))
