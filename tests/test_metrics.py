"""Request metrics against hand-made logs and the standard library."""

import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duecall.operators import metrics

LOG = "level INT, status STRING, latency DOUBLE, start TIMESTAMP, blank BOOLEAN"


def log(spark, rows):
    values = [(level, status, latency, None, False) for level, status, latency in rows]
    return spark.createDataFrame(values, LOG).withColumn(
        "start", F.timestamp_seconds(F.lit(1_000_000))
    )


def quantiles(values):
    cuts = statistics.quantiles(values, n=20) if len(values) >= 5 else [None] * 19
    return cuts[17], cuts[18]


def check_against_library(spark, groups):
    df = log(spark, [(g, "success", v) for g, values in groups.items() for v in values])
    tails = {r["level"]: r for r in metrics.latency_quantiles(df, ["level"]).collect()}
    stats = {r["level"]: r for r in metrics.latency_stats(df, ["level"]).collect()}
    assert set(tails) == set(stats) == set(groups)
    for group, values in groups.items():
        if len(values) >= 5:
            assert (tails[group]["p90"], tails[group]["p95"]) == pytest.approx(quantiles(values))
        else:
            assert tails[group]["p90"] is None and tails[group]["p95"] is None
        row = stats[group]
        assert row["median"] == pytest.approx(statistics.median(values))
        assert row["mean"] == pytest.approx(statistics.fmean(values))
        assert (row["min"], row["max"], row["successes"]) == (min(values), max(values), len(values))


def test_latency_measures(spark):
    rng = random.Random(7)
    check_against_library(
        spark,
        {
            0: [1.0, 2.0, 3.0, 4.0, 5.0],
            1: [1.0, 2.0, 3.0, 10.0],
            2: [4.2],
            3: [rng.choice([0.5, 0.5, 0.5, 3.0]) for _ in range(500)],
            4: [rng.lognormvariate(0, 3) for _ in range(2000)],
            5: [rng.uniform(-1, 1) for _ in range(300)] + [0.0] * 20,
            6: [4.5 + rng.random() * 1e-6 for _ in range(400)],
            None: [float(i) for i in range(11)],
        },
    )


def test_known_tail(spark):
    row = metrics.latency_quantiles(log(spark, [(1, "success", float(v)) for v in range(1, 6)]), ["level"]).first()
    assert (row["p90"], row["p95"]) == pytest.approx((5.4, 5.7))


def test_crowded_latencies_stay_spread(spark, monkeypatch):
    """A million latencies within a thousandth: ranges are cut until few rows are fetched."""
    from fractions import Fraction

    from duecall.operators import order_stats

    n = 1_000_000
    close = spark.range(n).select(
        (F.col("id") % 2).alias("level"),
        (F.lit(5.0) + F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * 4e-12).alias("latency"),
    )
    quantiles = {"median": Fraction(1, 2), "p95": Fraction(19, 20)}
    present = close.withColumn("value", F.col("latency")).withColumn("range", order_stats.value_range(F.col("value")))
    assert present.select("range").distinct().count() == 1
    found = order_stats.located_ranges(present, quantiles, ["level"]).collect()
    assert {r["level"] for r in found} == {0, 1} and max(r["n"] for r in found) <= order_stats.CROWDED
    got = {r["level"]: r for r in order_stats.exclusive_quantiles(close, "latency", quantiles, ["level"]).collect()}
    for level in (0, 1):
        values = sorted(r[0] for r in close.where(F.col("level") == level).select("latency").collect())
        m = len(values)
        for name, share in quantiles.items():
            at = share * (m + 1)
            j = int(at)
            want = values[j - 1] + float(at - j) * (values[j] - values[j - 1])
            assert got[level][name] == pytest.approx(want, rel=1e-14)
    # the smallest steps there are, and very many equal values
    monkeypatch.setattr(order_stats, "CROWDED", 3)
    tiny = [5e-324 * k for k in (0, 1, 2, 3, 5, 8, 8, 8, 8, 9)] + [1.0 + k * 2**-52 for k in range(10)] + [0.0, -0.0]
    check_against_library(spark, {1: tiny, 2: [7.5] * 50, 3: [1e300, -1e300, 1e-300] * 4, None: [2.0, 2.0, 2.0 + 2**-51] * 5})


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(0, 60, allow_nan=False), min_size=1, max_size=60))
def test_any_latencies(spark, values):
    check_against_library(spark, {1: values})


def test_failures_do_not_count_as_latency(spark):
    df = log(spark, [(1, "success", 1.0), (1, "error", 99.0), (2, "error", 5.0)])
    sweep = {r["level"]: r for r in metrics.load_sweep(df).collect()}
    assert sweep[1]["max"] == 1.0 and sweep[1]["success_rate"] == 50.0
    assert sweep[1]["wall_seconds"] == 99.0
    assert sweep[2]["successes"] == 0 and sweep[2]["mean"] is None and sweep[2]["p90"] is None


def test_counters_and_histogram(spark):
    rows = [("success", 0.02, False), ("error", 7.0, False), ("error", 0.0, True), ("success", 99.0, False)]
    df = spark.createDataFrame(rows, "status STRING, latency DOUBLE, blank BOOLEAN")
    counts = metrics.request_counters(df).first()
    assert (counts["requests"], counts["request_errors"]) == (4, 2)
    buckets = {r["le"]: r["cumulative"] for r in metrics.latency_histogram(df, [10.0, 0.02]).collect()}
    assert buckets == {"0.02": 1, "10.0": 2, "inf": 3}
    assert metrics.latency_histogram(df).first()["sum"] == pytest.approx(106.02)


def test_gauges_keep_the_latest_whole_line(spark):
    rows = [
        (1, "0, 10, 15360, 100"), (3, "0, 30, 15360, 300"), (2, "0, 20, 15360, 200"),
        (4, "0, 99"), (1, " 1 ,5.5,15360 , 7 "), (5, "1, 6, 15360, 8, extra"),
    ]
    df = spark.createDataFrame(rows, "ts INT, line STRING")
    got = {r["gpu"]: (r["util"], r["mem_total"], r["mem_used"]) for r in metrics.gpu_gauges(df).collect()}
    assert got == {"0": (30.0, 15360.0, 300.0), "1": (6.0, 15360.0, 8.0)}


def test_throughput(spark):
    df = spark.createDataFrame([(0.0, 1.0), (59.0, 1.0)], "s DOUBLE, latency DOUBLE").select(
        F.timestamp_seconds("s").alias("start"), "latency"
    )
    row = metrics.throughput(df).first()
    assert row["calls_per_minute"] == pytest.approx(2.0) and row["calls_per_hour"] == pytest.approx(120.0)


def test_empty_log(spark):
    empty = log(spark, [(1, "success", 1.0)]).where("false")
    assert metrics.success_rate(empty).first()["success_rate"] is None


def test_latest_gauge_does_not_depend_on_input_order(spark):
    lines = [(1, "0, 10, 100, 20"), (2, "0, 30, 100, 40"), (2, "0, 30, 100, 50"), (3, "0, [N/A], 100, 60")]
    for rows in (lines, lines[::-1]):
        df = spark.createDataFrame(rows, "ts INT, line STRING").coalesce(1)
        assert [tuple(r) for r in metrics.gpu_gauges(df).collect()] == [("0", 30.0, 100.0, 50.0)]
