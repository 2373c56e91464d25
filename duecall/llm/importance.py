"""Quality selection by importance resampling.

Two generative models over hashed words and word pairs are counted: one of target texts (all that
are labelled good), one of all raw texts. A text's log importance weight is the sum
over its n-grams of log target probability minus log raw probability. Adding Gumbel noise, seeded
by the row's key, and keeping the ``k`` largest sums draws ``k`` rows without replacement with
probabilities that follow the weights. Unless ``share`` says otherwise, as large a share is drawn as is
good among the labelled rows: the draw then keeps about as many rows as are worth keeping, and where
nearly all are good it leaves out little.

The raw model counts every row; counts are combined in each task, so the shuffle carries at most
``buckets`` rows per task. The ``k``-th largest sum is found by narrowing histograms, so nothing is
sorted as a whole; the last bin comes to the driver as a count per distinct value. The keys of good
rows go to every task up to ``MOST_BROADCAST`` of them, and meet the texts in a shuffle beyond.

Cases: a null text counts as empty, with weight 0. Without target texts all weights are 0 and the
draw is uniform. Rows with equal keys have equal noise; rows level with the ``k``-th are all taken.
An empty table gives an empty result. Columns of the input named like a result column are replaced.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecall.llm.shared import saved
from duecall.llm.text import TERM_BYTE, flat, lower_ascii, mix, slices, span_hashes, words

BUCKETS = 10_000
MOST_BROADCAST = 2_000_000
_LAST_BIN = 10_000
_BINS = 4096


def hashed_ngrams(data: np.ndarray, offsets: np.ndarray, buckets: int):
    """Bucket and row of every word and every pair of neighbouring words."""
    start, end, row = words(data, offsets, TERM_BYTE)
    h = span_hashes(lower_ascii(data), start, end)
    pair = row[1:] == row[:-1]
    pairs = mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])[pair]
    both = np.concatenate([h, pairs])
    return (both % np.uint64(buckets)).astype(np.int64), np.concatenate([row, row[:-1][pair]])


def count_ngrams(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``target`` and ``raw`` counts of rows (``text``, ``good``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets))
        for batch in batches:
            good = np.array(batch.column(1).to_pylist(), bool)
            for lo, hi in slices(batch.column(0)):
                bucket, row = hashed_ngrams(*flat(batch.column(0).slice(lo, hi - lo)), buckets)
                total[1] += np.bincount(bucket, minlength=buckets)
                total[0] += np.bincount(bucket, good[lo:hi][row], buckets)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(buckets)), *(pa.array(t.astype(np.int64)) for t in total)],
            names=["bucket", "target", "raw"],
        )

    counted = docs.select("text", "good").mapInArrow(
        count, "bucket bigint, target bigint, raw bigint"
    )
    return counted.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, prior: float = 1000.0) -> np.ndarray:
    """Log target minus log raw probability of every bucket; zeros without target texts.

    The target model starts from ``prior`` n-grams dealt out as the raw model has them.
    """
    total = np.zeros((2, buckets))
    for bucket, target, raw in counts.collect():  # one row per bucket
        total[:, bucket] = target, raw
    if not total[0].sum():
        return np.zeros(buckets)
    target, raw = total
    share = raw / raw.sum()
    mixed = (target + prior * share) / (target.sum() + prior)
    return np.log(np.divide(mixed, share, out=np.ones(buckets), where=share > 0))


def log_weights(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``log_weight``."""
    buckets = len(ratios)

    @F.arrow_udf("double")
    def weigh(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = np.zeros(len(column))
            for lo, hi in slices(column):
                bucket, row = hashed_ngrams(*flat(column.slice(lo, hi - lo)), buckets)
                out[lo:hi] = np.bincount(row, ratios[bucket], hi - lo)
            yield pa.array(out)

    return docs.withColumn("log_weight", weigh(F.col(f"`{text}`")))


def kth_largest(df: DataFrame, value: str, k: int) -> float | None:
    """Exactly the ``k``-th largest value (with the smallest if there are fewer); None if empty."""
    value = F.col(value)
    low, high, n = df.select(F.min(value), F.max(value), F.count(value)).first()
    if not n:
        return None
    above = 0
    k = min(max(k, 1), n)
    while n > _LAST_BIN and low < high:
        width = (high - low) / _BINS
        if low + width == low:
            break
        inside = df.where((value >= low) & (value <= high))
        number = F.least(F.floor((value - low) / width), F.lit(_BINS - 1))
        bins = inside.groupBy(number.alias("bin")).agg(
            F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
        )
        for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                low, high, n = row["low"], row["high"], row["n"]
                break
            above += row["n"]
    if low == high:
        return low
    # few rows, or values too close to be told apart by a bin: at most some thousands either way
    last = df.where((value >= low) & (value <= high)).groupBy(value.alias("v")).count().collect()
    for row in sorted(last, key=lambda r: -r["v"]):
        above += row["count"]
        if above >= k:
            return row["v"]
    return low


def resample(
    docs: DataFrame,
    labels: DataFrame,
    share: float | None = None,
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    buckets: int = BUCKETS,
    seed: int = 0,
) -> DataFrame:
    """``key``, ``log_weight``, ``gumbel_key`` and ``selected`` for every row of ``docs``.

    ``share`` of the rows is drawn; unset, the share of good rows (``label`` 1) among all labelled
    ones. Keys with several labels take the largest; null keys and labels are left out.
    """
    known = saved(
        labels.select(F.col(key), F.col(label))
        .where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(key)
        .agg((F.max(label) == 1).alias("good")),
        "labelled",
    )
    n_good, n_known = known.agg(F.count_if("good"), F.count("*")).first()
    if share is None:
        share = n_good / n_known if n_known else 1.0
    good = known.where("good").select(key, "good")
    if n_good <= MOST_BROADCAST:
        good = F.broadcast(good)
    rows = docs.select(F.col(key), F.col(text).alias("text"))
    marked = rows.join(good, key, "left").withColumn("good", F.expr("good is not null"))
    ratios = log_ratios(count_ngrams(marked, buckets), buckets)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52))
    noise = -F.log(-F.log((draw + 0.5) / float(1 << 52)))
    weighed = saved(
        log_weights(rows, ratios)
        .drop("text")
        .withColumn("gumbel_key", F.col("log_weight") + noise),
        "importance",
    )
    n = weighed.count()
    k = round(share * n)
    least = kth_largest(weighed, "gumbel_key", k) if k else None
    chosen = F.lit(False) if least is None else F.col("gumbel_key") >= least
    return weighed.withColumn("selected", chosen)
