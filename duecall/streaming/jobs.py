"""Streaming outcomes, request metrics and gauges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from duecall.operators.clean import clean_answers
from duecall.operators.metrics import gpu_readings, latest_by_gpu, success_columns, succeeded
from duecall.operators.parse import parse_generations


def read_parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stream over a Parquet file or folder, with the schema its files have now.

    The stream source wants a folder or a pattern; a pattern that matches only ``path`` serves
    for both a single file and a folder.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def stream_dispositions(generations: DataFrame) -> DataFrame:
    """Outcomes of a stream of generations; stateless, for append mode."""
    return clean_answers(parse_generations(generations))


def stream_request_metrics(
    log: DataFrame, window: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Request counts, failures and mean latency per tumbling window of ``start``.

    In append mode a window is written once the watermark has passed it and its state is freed; in
    update mode its row is written whenever a batch has changed it.
    """
    good = succeeded()
    return (
        log.withWatermark("start", delay)
        .groupBy(F.window("start", window).alias("window"))
        .agg(
            *success_columns(),
            F.count_if(~good | F.col("blank")).alias("request_errors"),
            F.avg(F.when(good, F.col("latency"))).alias("mean_latency"),
            F.max(F.when(good, F.col("latency"))).alias("max_latency"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "*",
        )
        .drop("window")
    )


def stream_latest_gauge(samples: DataFrame, ts: str = "ts", line: str = "line") -> DataFrame:
    """Latest sample of every GPU seen so far; the state is one row per GPU."""
    return latest_by_gpu(samples, ts, line)


def _availability(stale_us: int):
    """Changes of one GPU's availability; the state is its last reading and whether it is available."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, available = state.get if state.exists else (None, None)
        since, values = [], []
        if state.hasTimedOut:
            since, values, available = [last + stale_us], [False], False
        else:
            readings = pd.concat(list(frames)).groupby("ts", sort=True)["ok"].min()
            at = readings.index.as_unit("us").asi8
            ok = readings.to_numpy(bool)
            before_at = np.concatenate(([last if last is not None else at[0]], at[:-1]))
            before_ok = np.concatenate(([bool(available)], ok[:-1]))
            lapsed = before_at + stale_us < at
            fell = lapsed & before_ok
            changed = (before_ok & ~lapsed) != ok
            changed[0] |= last is None
            since = np.concatenate([before_at[fell] + stale_us, at[changed]])
            values = np.concatenate([np.zeros(int(fell.sum()), bool), ok[changed]])
            last, available = int(at[-1]), bool(ok[-1])
            if available and (last + stale_us) // 1000 < state.getCurrentWatermarkMs():
                since, values = np.append(since, last + stale_us), np.append(values, False)
                available = False
        state.update((last, available))
        if available:
            state.setTimeoutTimestamp(-(-(last + stale_us) // 1000))
        if len(since):
            when = pd.to_datetime(np.asarray(since, np.int64), unit="us")
            yield pd.DataFrame({"gpu": key[0], "since": when, "available": np.asarray(values, bool)})

    return follow


def stream_gpu_availability(
    samples: DataFrame, stale_seconds: int = 15, delay: str = "0 seconds", ts: str = "ts", line: str = "line"
) -> DataFrame:
    """The changes that ``gpu_availability`` finds, written as they happen, for append mode.

    A timer per GPU fires once the watermark has passed its last reading by ``stale_seconds``.
    Readings of a GPU that come in one batch are put in order; those older than the watermark
    are dropped. Limit the files of a batch where one GPU may send very many.
    """
    readings = gpu_readings(samples, ts, line).withWatermark("ts", delay)
    return readings.groupBy("gpu").applyInPandasWithState(
        _availability(stale_seconds * 1_000_000),
        "gpu STRING, since TIMESTAMP, available BOOLEAN",
        "last BIGINT, available BOOLEAN",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Processes what is there and stops; rows go to Parquet files from the executors."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def closed_and_open(closed: DataFrame, log: DataFrame, window: str = "1 hour") -> DataFrame:
    """Windows that a stream in append mode has written, and those still open, from the ``log``.

    The watermark closes windows in the order of their ends, so the open ones start where the last
    closed one ends; only that part of the log is read again.
    """
    upto = closed.agg(F.max("window_end")).first()[0]
    rest = log if upto is None else log.where(F.col("start") >= F.lit(upto))
    return closed.unionByName(stream_request_metrics(rest, window).select(*closed.columns))


def run_upserts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Processes what is there and stops; every batch's new and changed rows go to files of their
    own folder, from the executors.

    A batch that is repeated after a failure replaces its folder, so nothing counts twice. With a
    watermark in ``stream``, state is freed as windows close.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_upserts(
    spark: SparkSession, path: str, schema: T.StructType, keys: list[str]
) -> DataFrame:
    """The newest row of every key that ``run_upserts`` has written."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rest = F.struct(*[name for name in schema.names if name not in keys])
    rows = spark.read.schema(whole).parquet(path)
    newest = rows.groupBy(*keys).agg(F.max_by(rest, "batch").alias("row"))
    return newest.select(*keys, "row.*").select(*schema.names)
