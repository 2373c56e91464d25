"""From generated text to a parsed answer or an error on the same row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecall.functions.answers import only_object, parse_in_brackets, slice_json
from duecall.functions.fence import fenced
from duecall.vocabulary import BAD_JSON, NO_JSON


def parse_generations(df: DataFrame, text: str = "generation") -> DataFrame:
    """Adds ``answer`` (VARIANT) and ``parse_error``; exactly one of them is null."""
    sliced = (
        df.withColumn("__slice", slice_json(F.col(text)))
        .withColumn("__array", parse_in_brackets(F.col("__slice")))
        .withColumn("__answer", only_object(F.col("__array"), F.col("__slice")))
    )
    error = F.when(F.col("__slice").isNull(), F.lit(NO_JSON)).when(
        F.col("__answer").isNull(), F.lit(BAD_JSON)
    )
    return fenced(sliced, df.columns, {"answer": F.col("__answer"), "parse_error": error})


def split_errors(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with an outcome, failed rows). A model that writes an ``error`` key has failed too."""
    return cleaned.where(~F.col("failed")), cleaned.where(F.col("failed"))
