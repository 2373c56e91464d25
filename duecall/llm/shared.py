"""Tables written to the shared folder, filters ahead of joins, and labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecall.session import scratch_dir

LABELLED_BOUND = 20_000
# of a filter ahead of a join: keys per word of 64 bits, and words at most
_WORD_KEYS = 4
_MOST_WORDS = 1 << 19


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe if an executor
    that computed a part is lost."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _flagged(df: DataFrame, keys: DataFrame, on: tuple[str, ...]) -> tuple[DataFrame, Column, list[str]]:
    """``df`` with helper columns, whether a row's columns ``on`` may be among those of ``keys``, and
    the helper columns' names."""
    word, mask, bits = helpers = [f"{free_prefix(df)}{name}" for name in ("word", "mask", "bits")]
    size = max(1, min(keys.count() // _WORD_KEYS, _MOST_WORDS))
    columns = [F.col(f"`{c}`") for c in on]
    of = F.pmod(F.xxhash64(*columns), F.lit(size)).alias(word)
    # four bits of a word stand for a key
    spread = F.xxhash64(F.lit("bits"), *columns)
    place = [F.pmod(F.shiftright(spread, k), F.lit(64)).cast("int") for k in (0, 6, 12, 18)]
    four = [F.call_function("shiftleft", F.lit(1).cast("bigint"), p) for p in place]
    mine = four[0].bitwiseOR(four[1]).bitwiseOR(four[2]).bitwiseOR(four[3]).alias(mask)
    words = keys.select(of, mine).groupBy(word).agg(F.bit_or(mask).alias(bits))
    found = df.select("*", of, mine).join(F.broadcast(words), word, "left")
    return found, F.coalesce(F.col(bits).bitwiseAND(F.col(mask)) == F.col(mask), F.lit(False)), helpers


def likely(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """The rows of ``df`` whose columns ``on`` are among those of ``keys``, and about one in 100 of the
    others, more from some four million keys on. Ahead of a join it keeps most of ``df`` from being moved.

    Bits for hashes of the keys go to all tasks, half a million words at most, whatever the input.
    """
    found, flag, helpers = _flagged(df, keys, on)
    return found.where(flag).drop(*helpers)


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not among those of ``keys``; only rows that may be among
    them are moved. ``df`` is read twice."""
    found, flag, helpers = _flagged(df, keys, (key,))
    doubtful = found.where(flag).drop(*helpers).join(keys.select(key), key, "left_anti")
    return found.where(~flag).drop(*helpers).union(doubtful.select(*df.columns))


def labelled_rows(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """``key`` and ``label`` of all labelled rows. Keys with several labels take the largest; null keys
    and labels are left out."""
    return (
        labels.select(F.col(key), F.col(label))
        .where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(key)
        .agg(F.max(label).alias(label))
    )


def labelled_sample(
    labels: DataFrame, label: str, bound: int = LABELLED_BOUND, key: str = "doc_id"
) -> DataFrame:
    """``labelled_rows``, about ``bound`` at most (all, if there are no more).

    The rows are those with the smallest hash of the key, so a run can be repeated.
    """
    known = labelled_rows(labels, label, key)
    share = bound / max(known.count(), 1)
    if share >= 1:
        return known
    return known.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(share * (1 << 40)))


def free_prefix(df: DataFrame) -> str:
    """A start for names of helper columns that no column of ``df`` has."""
    prefix = "__"
    while any(name.lower().startswith(prefix) for name in df.columns):
        prefix += "_"
    return prefix
