"""Keeping filters above expensive columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` and the new columns, where filters on the new columns stay above them.

    The optimizer moves a filter below a projection by writing the projected expressions into its
    condition. Through a chain of parsing steps that evaluates each of them again, and the
    condition grows with every step. It does not move a filter on the output of a generator, so
    the columns leave as the single row of an inline table. Filters on ``keep`` still move down.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*[F.col(f"`{name}`") for name in keep], F.inline(F.array(row)))
