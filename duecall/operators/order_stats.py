"""Exact order statistics of large groups.

Neither a window over a whole group nor an aggregate that keeps every value of it holds up when
one group has a third of the rows. Here counts per value range, combined before their shuffle, tell
in which range a wanted rank lies. A range that holds many rows is cut into ``_CUTS`` ranges of its
own and counted again, as often as it takes: crowded values stay spread, however close they lie.
Only the values of the last, sparse ranges are fetched, combined per distinct value and ranked.
Narrow scans, no shuffle of the rows, and no window over more than a few thousand rows.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecall.session import written

# rows of a range from which on it is cut further, and the ranges it is cut into
CROWDED = 50_000
_CUTS = 4096
_LEAST_DOUBLE = 5e-324


def value_range(value: Column) -> Column:
    """Number of the first range of a value; grows with the value.

    Ranges are a hundredth of the value wide (a hundred-thousandth near zero), so any double falls
    in one of about 140,000 and a real measurement in a few hundred.
    """
    return F.floor(F.signum(value) * F.log1p(F.abs(value) * 1000) * 100)


def _counts(present: DataFrame, keys: list[str]) -> DataFrame:
    number = F.col("value").cast("double")
    return present.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(number).alias("low"), F.max(number).alias("high")
    )


def _holding(counted: DataFrame, by: list[str], quantiles: dict[str, Fraction]) -> DataFrame:
    """The first ranges that hold a wanted rank: ``by``, ``range``, ``n``, ``low``, ``high``,
    ``total``, the number of rows ``before``, and the ``quantiles`` within."""
    below = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    summed = counted.withColumns(
        {
            "before": F.coalesce(F.sum("n").over(below), F.lit(0)),
            "total": F.sum("n").over(Window.partitionBy(*by)),
        }
    )
    return _keep_wanted(summed.withColumn("quantiles", _wanted(quantiles)))


def _keep_wanted(ranges: DataFrame) -> DataFrame:
    """Ranges with only the quantiles whose rank they hold; those without any go."""
    inside = F.filter(
        "quantiles",
        lambda q: (q["rank"] > F.col("before")) & (q["rank"] <= F.col("before") + F.col("n")),
    )
    return ranges.withColumn("quantiles", inside).where(F.size("quantiles") > 0)


def _is_crowded() -> Column:
    """Many rows, of more than one value that a double can tell apart."""
    return (F.col("n") > CROWDED) & (F.col("low") < F.col("high"))


def _met(present: DataFrame, ranges: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Rows of ``present`` that lie in one of the ``ranges``, with the columns ``values`` of it."""
    ranges = ranges.select(
        *[F.col(c).alias(f"_{c}") for c in [*by, "range", "low", "high"]],
        *[F.col(c) for c in values],
    )
    number = F.col("value").cast("double")
    same = (F.col("range") == F.col("_range")) & number.between(F.col("_low"), F.col("_high"))
    for column in by:
        same = same & F.col(column).eqNullSafe(F.col(f"_{column}"))
    return present.join(ranges, same)


def _cut(present: DataFrame, crowded: DataFrame, by: list[str]) -> DataFrame:
    """The ranges that hold a wanted rank, each a part of one of the ``crowded`` ones."""
    low, high = F.col("_low"), F.col("_high")
    # the lowest value falls in part 0 and the highest in another, so every cut gets on
    width = F.greatest(high / _CUTS - low / _CUTS, F.lit(_LEAST_DOUBLE))
    part = F.least(F.floor((F.col("value").cast("double") - low) / width), F.lit(_CUTS))
    keys = [*by, "range", "_low", "_high", "part"]
    parts = _counts(_met(present, crowded, by, []).withColumn("part", part), keys)
    held = crowded.select(
        *[F.col(c).alias(f"__{c}") for c in [*by, "range", "low", "high"]], "before", "total", "quantiles"
    )
    same = F.lit(True)
    for column in [*by, "range"]:
        same = same & F.col(column).eqNullSafe(F.col(f"__{column}"))
    same = same & (F.col("_low") == F.col("__low")) & (F.col("_high") == F.col("__high"))
    below = Window.partitionBy(*by, "range", "_low", "_high").orderBy("part")
    below = below.rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before") + F.coalesce(F.sum("n").over(below), F.lit(0))
    summed = parts.join(held, same).withColumn("before", before)
    columns = [*by, "range", "n", "low", "high", "before", "total", "quantiles"]
    return _keep_wanted(summed.select(*columns))


def located_ranges(present: DataFrame, quantiles: dict[str, Fraction], by: list[str]) -> DataFrame:
    """Ranges that hold all wanted ranks, none of them crowded.

    A cut divides the width of a range by ``_CUTS``, so doubles come apart after five at most. Few
    rows: two per quantile and group.
    """
    ranges = written(_holding(_counts(present, [*by, "range"]), by, quantiles), "ranges")
    found = ranges.where(~_is_crowded())
    while not (crowded := ranges.where(_is_crowded())).isEmpty():
        ranges = written(_cut(present, crowded, by), "ranges")
        found = found.union(ranges.where(~_is_crowded()))
    return found


def exclusive_quantiles(
    df: DataFrame, value: str, quantiles: dict[str, Fraction], by: list[str]
) -> DataFrame:
    """One row per group: ``by`` and one column per quantile of the values that are not null.

    The quantile p of n values lies at rank p(n+1), interpolated between the neighbours at ranks
    j and j+1, where j stays within 1..n-1; near the ends this extrapolates. One value is its own
    quantile. Values that are not a number are left out.
    """
    present = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .select(*by, F.col(value).alias("value"))
        .withColumn("range", value_range(F.col("value")))
    )
    located = located_ranges(present, quantiles, by)
    keys = [*by, "range", "_low", "_high", "before", "total"]
    upto = Window.partitionBy(*keys).orderBy("value")
    upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.col("quantile.rank")
    ranked = (
        _met(present, located, by, ["before", "total", "quantiles"])
        .groupBy(*keys, "quantiles", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.col("before") + F.sum("n").over(upto))
        .withColumn("quantile", F.explode("quantiles"))
        .where((rank > F.col("upto") - F.col("n")) & (rank <= F.col("upto")))
    )
    return ranked.groupBy(*by).agg(
        *[_interpolated(name, share).alias(name) for name, share in quantiles.items()]
    )


def _lower_rank(share: Fraction) -> Column:
    """j: floor of share * (total + 1), within 1..total-1."""
    rank = F.floor((F.col("total") + 1) * share.numerator / share.denominator)
    return F.greatest(F.least(rank, F.col("total") - 1), F.lit(1)).cast("bigint")


def _wanted(quantiles: dict[str, Fraction]) -> Column:
    entries = []
    for name, share in quantiles.items():
        lower = _lower_rank(share)
        upper = F.least(lower + 1, F.col("total"))
        for side, rank in (("low", lower), ("high", upper)):
            entries.append(
                F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank.alias("rank"))
            )
    return F.array(*entries)


def _interpolated(name: str, share: Fraction) -> Column:
    def at(side: str) -> Column:
        chosen = (F.col("quantile.name") == name) & (F.col("quantile.side") == side)
        return F.max(F.when(chosen, F.col("value")))

    total, lower = F.max("total"), F.max(_lower_rank(share))
    weight = (total + 1) * share.numerator - lower * share.denominator
    return (at("low") * (share.denominator - weight) + at("high") * weight) / share.denominator
