"""Service metrics over a request log.

Log columns: ``status`` (success or error), ``latency`` in seconds, ``start`` TIMESTAMP,
``blank`` BOOLEAN for requests rejected before inference. Every metric is one aggregation with
partial results before its shuffle.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecall.operators.order_stats import exclusive_quantiles
from duecall.schemas import GPU_SAMPLE

# Smallest number of latencies for which tail quantiles are reported.
MIN_FOR_TAIL = 5
MEDIAN = {"median": Fraction(1, 2)}
TAIL = {"p90": Fraction(9, 10), "p95": Fraction(19, 20)}


def succeeded() -> Column:
    return F.col("status") == "success"


def success_columns() -> list[Column]:
    total, good = F.count(F.lit(1)), F.count_if(succeeded())
    return [
        total.alias("total"),
        good.alias("successes"),
        (total - good).alias("errors"),
        (F.try_divide(good, total) * 100).alias("success_rate"),
        (100 - F.try_divide(good, total) * 100).alias("error_rate"),
    ]


def success_rate(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    return log.groupBy(*(by or [])).agg(*success_columns())


def _simple_latency(seen: Column) -> list[Column]:
    """Mean, minimum and maximum of the latencies that are ``seen``."""
    latency = F.when(seen, F.col("latency"))
    return [F.avg(latency).alias("mean"), F.min(latency).alias("min"), F.max(latency).alias("max")]


def latency_stats(log: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean, median, minimum and maximum latency of the successful requests, per group."""
    good = log.where(succeeded())
    simple = good.groupBy(*by).agg(
        F.count("latency").alias("successes"), *_simple_latency(F.lit(True))
    )
    return _beside(simple, exclusive_quantiles(good, "latency", MEDIAN, by), by)


def latency_quantiles(log: DataFrame, by: list[str]) -> DataFrame:
    """P90 and P95 of the successful requests, null for fewer than five; per group."""
    good = log.where(succeeded())
    counts = good.groupBy(*by).agg(F.count("latency").alias("successes"))
    return _tail_if_enough(_beside(counts, exclusive_quantiles(good, "latency", TAIL, by), by))


def _tail_if_enough(stats: DataFrame) -> DataFrame:
    enough = F.col("successes") >= MIN_FOR_TAIL
    return stats.withColumns({name: F.when(enough, F.col(name)) for name in TAIL})


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Joins two results that have one row per group; a null group finds its partner."""
    renamed, same = right, F.lit(True)
    for column in by:
        renamed = renamed.withColumnRenamed(column, f"_other_{column}")
        same = same & F.col(column).eqNullSafe(F.col(f"_other_{column}"))
    return left.join(renamed, same, "left").drop(*[f"_other_{column}" for column in by])


def load_sweep(log: DataFrame, level: str = "level") -> DataFrame:
    """Per concurrency level: outcome counts, wall time and all latency measures."""
    end = F.unix_micros("start") / 1e6 + F.col("latency")
    wall = F.max(end) - F.min(F.unix_micros("start")) / 1e6
    outcome = log.groupBy(level).agg(
        *success_columns(), wall.alias("wall_seconds"), *_simple_latency(succeeded())
    )
    spread = exclusive_quantiles(log.where(succeeded()), "latency", MEDIAN | TAIL, [level])
    return _tail_if_enough(_beside(outcome, spread, [level]))


def request_counters(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Requests, counted before validation, and failed requests, blank ones included."""
    return log.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(~succeeded() | F.col("blank")).alias("request_errors"),
    )


# The usual bounds of a metrics client for durations in seconds.
DEFAULT_BOUNDS = [
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
]


def latency_histogram(log: DataFrame, bounds: list[float] | None = None) -> DataFrame:
    """Cumulative buckets, sum and count of inference time.

    Failed requests are observed; blank ones never reached the model. One pass: a conditional
    count per bound, then one row per bucket.
    """
    limits = [*sorted(bounds or DEFAULT_BOUNDS), float("inf")]
    observed = log.where(~F.col("blank"))
    counted = observed.agg(
        *[F.count_if(F.col("latency") <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(limits)],
        F.sum("latency").alias("sum"),
        F.count("latency").alias("count"),
    )
    buckets = F.array(
        *[
            F.struct(F.lit(str(bound)).alias("le"), F.col(f"b{i}").alias("cumulative"))
            for i, bound in enumerate(limits)
        ]
    )
    return counted.select(F.inline(buckets), "sum", "count")


def parse_gpu_samples(samples: DataFrame, line: str = "line") -> DataFrame:
    """Columns gpu, util, mem_total and mem_used of CSV lines; lines of fewer parts, or with a
    value that is not a number, are left out."""
    parts = F.split(F.col(line), ",")
    parsed = samples.where(F.size(parts) >= 4).withColumn(
        "_sample",
        F.from_csv(
            F.col(line),
            GPU_SAMPLE,
            {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"},
        ),
    )
    readings = parsed.select(*samples.columns, "_sample.*")
    # a reading that is not a number leaves the gauge as it was
    return readings.dropna(subset=["util", "mem_total", "mem_used"])


def latest_by_gpu(samples: DataFrame, ts: str, line: str) -> DataFrame:
    """All values of a GPU's latest line; of lines at the same time, of the greatest one."""
    values = F.struct("util", "mem_total", "mem_used")
    latest = F.max_by(values, F.struct(F.col(ts), F.col(line))).alias("latest")
    return parse_gpu_samples(samples, line).groupBy("gpu").agg(latest).select("gpu", "latest.*")


def gpu_gauges(samples: DataFrame, ts: str = "ts", line: str = "line") -> DataFrame:
    """Latest sample of every GPU."""
    return latest_by_gpu(samples, ts, line)


def gpu_readings(samples: DataFrame, ts: str = "ts", line: str = "line") -> DataFrame:
    """``gpu``, ``ts`` and ``ok`` of every poll that names a GPU: a whole line of numbers, or not."""
    gpu = F.trim(F.split_part(F.col(line), F.lit(","), F.lit(1)))
    row = F.from_csv(
        F.col(line),
        GPU_SAMPLE,
        {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"},
    )
    polled = samples.select(gpu.alias("gpu"), F.col(ts).alias("ts"), row.alias("row"), line)
    whole = (F.size(F.split(F.col(line), ",")) >= 4) & F.expr(
        "row.util IS NOT NULL AND row.mem_total IS NOT NULL AND row.mem_used IS NOT NULL"
    )
    named = (F.col("gpu") != "") & F.col("ts").isNotNull()
    return polled.where(named).select("gpu", "ts", F.coalesce(whole, F.lit(False)).alias("ok"))


def gpu_availability(
    samples: DataFrame, stale: str = "15 seconds", ts: str = "ts", line: str = "line"
) -> DataFrame:
    """When each GPU became available or not: ``gpu``, ``since`` and ``available``.

    A good reading makes a GPU available; a failed one, or none for ``stale``, makes it unavailable,
    in the second case from the moment its last reading is that old. Of readings at one time a
    failed one counts. The end of the log is the time of its last reading, of any GPU.

    Readings meet their predecessor hour by hour, so no task orders all readings of a GPU; the
    first of an hour meets the last of the hours before.
    """
    grown_stale = F.expr(f"INTERVAL {stale}")
    readings = (
        gpu_readings(samples, ts, line)
        .groupBy("gpu", "ts")
        .agg(F.min("ok").alias("ok"))
        .withColumn("hour", F.date_trunc("hour", "ts"))
    )
    reading = F.struct("ts", "ok")
    hours = readings.groupBy("gpu", "hour").agg(F.max(reading).alias("last"))
    in_turn = Window.partitionBy("gpu").orderBy("hour")
    hours = hours.select(
        F.col("gpu").alias("_gpu"),
        F.col("hour").alias("_hour"),
        F.lag("last").over(in_turn).alias("_before"),
    )
    same = (F.col("gpu") == F.col("_gpu")) & (F.col("hour") == F.col("_hour"))
    within = Window.partitionBy("gpu", "hour").orderBy("ts")
    met = (
        readings.withColumn("_previous", F.lag(reading).over(within))
        .join(hours, same)
        .withColumn("before", F.coalesce("_previous", "_before"))
    )
    lapsed = F.col("before.ts") + grown_stale < F.col("ts")
    state = F.when(lapsed, F.lit(False)).otherwise(F.col("before.ok"))
    changed = state.isNull() | (state != F.col("ok"))
    changes = F.array(
        F.when(lapsed & F.col("before.ok"), _change(F.col("before.ts") + grown_stale, F.lit(False))),
        F.when(changed, _change(F.col("ts"), F.col("ok"))),
    )
    seen = met.select("gpu", F.inline(F.array_compact(changes)))
    # one row per GPU, and one for the whole log
    last = readings.groupBy("gpu").agg(F.max(reading).alias("last"))
    end = F.max("last.ts").over(Window.partitionBy(F.lit(0)))
    at = F.col("last.ts") + grown_stale
    silent = last.withColumn("end", end).where(F.col("last.ok") & (at < F.col("end")))
    return seen.union(silent.select("gpu", at.alias("since"), F.lit(False).alias("available")))


def _change(since: Column, available: Column) -> Column:
    return F.struct(since.alias("since"), available.alias("available"))


def throughput(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls per minute and per hour between the first start and the last end."""
    start = F.unix_micros("start") / 1e6
    seconds = F.max(start + F.col("latency")) - F.min(start)
    return (
        log.groupBy(*(by or []))
        .agg(F.count(F.lit(1)).alias("calls"), seconds.alias("seconds"))
        .withColumns(
            {
                "calls_per_minute": F.try_divide("calls", "seconds") * 60,
                "calls_per_hour": F.try_divide("calls", "seconds") * 3600,
            }
        )
    )
