"""Importance resampling towards a target distribution, with integer weights.

Every text is cut into words (A-Z lower-cased; letters, digits and all non-ASCII characters), its
features are the runs of 1 to ``longest`` words, and a feature falls into the bucket crc32 of its
bytes modulo ``buckets``. A bucket's gain is floor(1000 ln) of its smoothed target probability over
its smoothed raw probability; a text's weight is the floored mean of the gains of its features. Its
score adds Gumbel noise drawn from sha256 of the row's key, and the highest scores are drawn.

**Interning.** Each slice of a batch goes through one open-addressed table (``slot_table``): equal
features share a slot, which holds their bucket and count. Buckets are computed once per slot; raw
and target counts are sums of slot counts, and an occurrence's gain is gathered by its slot.

**Scale.** Counting gives at most ``buckets`` rows per task, combined before their shuffle; the
driver holds one count per bucket. The least drawn score is found from counts per range of scores
and then per score, whole numbers that logarithms bound. Ranks come from a range partitioning of
the drawn rows: a row's rank is its place in its part plus the rows of the parts before.

Cases: a null text has no words; a text without features has weight 0. A row whose key is null
draws the noise of the empty key; equal keys draw equal noise. Rows level in score rank by key
(null first), rows level in both by weight, then number of features, then in any order. An empty
target makes every gain follow from the raw counts alone; an empty table gives an empty result.
Only the key and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duecall.llm.shared import saved
from duecall.llm.slot_table import Spans, intern
from duecall.llm.text import TERM_BYTE, flat, lower_ascii, slices, words

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
_RANGE = 512


def features(
    data: np.ndarray, offsets: np.ndarray, longest: int
) -> tuple[Spans, np.ndarray, np.ndarray]:
    """All runs of 1 to ``longest`` words, the row of each, and the number of words per row."""
    data = lower_ascii(data)
    start, end, row = words(data, offsets, TERM_BYTE)
    # the words again, with one space after each: a run of words is then one span
    size = end - start
    at = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 32, np.uint8)
    letter = np.ones(len(joined), bool)
    letter[at + size] = False
    place = np.flatnonzero(letter)
    joined[place] = data[place + np.repeat(start - at, size)]
    starts, ends, rows = [], [], []
    for k in range(longest):
        whole = np.flatnonzero(row[k:] == row[: len(row) - k]) if k < len(row) else np.zeros(0, int)
        starts.append(at[whole])
        ends.append(at[whole + k] + size[whole + k])
        rows.append(row[whole])
    spans = Spans(joined, np.concatenate(starts), np.concatenate(ends))
    return spans, np.concatenate(rows), np.bincount(row, minlength=len(offsets) - 1)


def interned(spans: Spans, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of every occurrence, and the bucket and count of every slot."""
    slot, opened_by = intern(spans)
    bucket = np.zeros(len(opened_by), np.int64)
    for at in np.flatnonzero(opened_by >= 0):
        bucket[at] = zlib.crc32(spans.bytes_of(opened_by[at])) % buckets
    return slot, bucket, np.bincount(slot, minlength=len(opened_by))


def count_buckets(
    docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS
) -> dict[int, int]:
    """Features of all texts per bucket; one number per bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            column = batch.column(0)
            for lo, hi in slices(column):
                spans, _, _ = features(*flat(column.slice(lo, hi - lo)), longest)
                _, bucket, n = interned(spans, buckets)
                np.add.at(total, bucket, n)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"]
        )

    counted = docs.select(F.col(f"`{text}`")).mapInArrow(count, "bucket bigint, n bigint")
    return {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def bucket_gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket."""
    s_all, t_all = sum(raw.values()), sum(target.values())
    return np.array(
        [
            math.floor(
                1000
                * math.log(
                    float(target.get(b, 0) + 1) * float(s_all + buckets)
                    / (float(raw.get(b, 0) + 1) * float(t_all + buckets))
                )
            )
            for b in range(buckets)
        ],
        np.int64,
    )


def weights(docs: DataFrame, gains: np.ndarray, key: str, text: str, longest: int) -> DataFrame:
    """``key``, ``n_words``, ``n_features`` and ``weight`` of every row."""
    buckets = len(gains)

    @F.arrow_udf("n_words bigint, n_features bigint, weight bigint")
    def weigh(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = np.zeros((3, len(column)), np.int64)
            for lo, hi in slices(column):
                spans, row, n_words = features(*flat(column.slice(lo, hi - lo)), longest)
                slot, bucket, _ = interned(spans, buckets)
                total = np.zeros(hi - lo, np.int64)
                np.add.at(total, row, gains[bucket][slot])
                n = np.bincount(row, minlength=hi - lo)
                out[:, lo:hi] = n_words, n, total // np.maximum(n, 1)
            yield pa.StructArray.from_arrays(
                [pa.array(x) for x in out], ["n_words", "n_features", "weight"]
            )

    found = docs.select(F.col(f"`{key}`").alias("key"), weigh(F.col(f"`{text}`")).alias("found"))
    return found.select("key", "found.*")


def _least_drawn(scored: DataFrame, k: int) -> int | None:
    """The ``k``-th highest score of the eligible rows."""
    if k < 1:
        return None
    left = k
    eligible = scored.where("eligible")
    # a few hundred ranges of scores, then the scores of one range
    ranges = eligible.groupBy(F.floor(F.col("score") / _RANGE).alias("part")).count().collect()
    for part, n in sorted(((r[0], r[1]) for r in ranges), reverse=True):
        if left <= n:
            break
        left -= n
    inside = eligible.where(F.floor(F.col("score") / _RANGE) == part).groupBy("score").count()
    for score, n in sorted(((r[0], r[1]) for r in inside.collect()), reverse=True):
        if left <= n:
            return score
        left -= n
    return None


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3, ... by score, then key; null past ``k``."""
    order = [F.desc("score"), F.asc("key"), F.desc("weight"), F.desc("n_features")]
    parts = saved(
        rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "drawn"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))  # one row per part
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = parts.withColumn("place", place).join(F.broadcast(starts), "part")
    rank = F.col("start") + F.col("place")
    return ranked.withColumn("rank", F.when(rank <= k, rank))


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: str = SEED,
) -> DataFrame:
    """``key``, ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn) of every row.

    Drawn are the floor(``percent`` N / 100) highest scores of the N texts with at least
    ``least_words`` words.
    """
    gains = bucket_gains(
        count_buckets(docs, text, longest, buckets),
        count_buckets(target, target_text, longest, buckets),
        buckets,
    )
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    digits = F.substring(F.sha2(name.cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = saved(
        weights(docs, gains, key, text, longest).select(
            "key",
            "n_features",
            "weight",
            (F.col("weight") + noise).alias("score"),
            (F.col("n_words") >= least_words).alias("eligible"),
        ),
        "scored",
    )
    k = percent * scored.where("eligible").count() // 100
    least = _least_drawn(scored, k)
    kept = F.col("key").alias(key), "n_features", "weight", "score"
    if least is None:
        return scored.select(*kept, F.lit(None).cast("bigint").alias("rank"))
    high = F.col("eligible") & (F.col("score") >= least)
    drawn = _ranked(scored.where(high), k).select(*kept, F.col("rank").cast("bigint").alias("rank"))
    return scored.where(~high).select(*kept, F.lit(None).cast("bigint").alias("rank")).union(drawn)
