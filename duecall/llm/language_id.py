"""Language identification by rank-order profiles of character n-grams.

A language's profile lists its most frequent n-grams of one to three letters in order. A text is
compared with every profile by out-of-place distance: the sum, over the text's own most frequent
n-grams, of how far each one's rank lies from its rank in the profile; an n-gram the profile lacks
costs the profile's length.

Learning counts n-grams on all training rows, combined in each task and again before the shuffle,
so a dominant language costs no more than its distinct n-grams. Profiles (languages x ``size``
rows) are the only thing sent to the tasks.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when no
language was learned. Rows with a null language are not learned from. Equal counts are ordered by
n-gram, equal distances by language name. Repeated rows count each time. Columns of the input
named like a result column are replaced by it.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import unicodedata
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duecall.llm.shared import free_prefix
from duecall.llm.text import runs, slices

PROFILE_SIZE = 400
SLICE = 1 << 18  # bytes of text whose n-grams are held at once
HELD_GRAMS = 500_000  # counts that wait to be merged, or as many as there are distinct ones
UNKNOWN = "und"
_PAD = 1
_kinds = np.full(0x110000, 255, np.uint8)


def _letters(codes: np.ndarray) -> np.ndarray:
    """2 for letters, 1 for marks that belong to one, 0 for anything else."""
    kinds = _kinds[codes]
    if (kinds == 255).any():
        for code in np.unique(codes[kinds == 255]):
            kind = unicodedata.category(chr(code))[0]
            _kinds[code] = 2 if kind == "L" else 1 if kind == "M" else 0
        kinds = _kinds[codes]
    return kinds


def ngrams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (row in the high 16 bits, n-gram of 16-bit letters below) and, per row, whether
    it has a letter. Letters beyond the basic plane are folded into the private-use area."""
    joined = "\0" + "\0".join((t or "").replace("\0", " ") for t in texts) + "\0"
    codes = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _letters(codes)
    fence = codes == 0
    inside = kinds > 0
    keep = inside | fence
    keep[1:] |= inside[:-1]
    row = (np.cumsum(fence) - 1)[keep].astype(np.uint64)
    inside = inside[keep]
    letter = np.bincount(row[kinds[keep] == 2].astype(np.int64), minlength=len(texts)) > 0
    codes = codes[keep].astype(np.uint64)
    codes = np.where(codes > 0xFFFF, 0xE000 + codes % np.uint64(0x1900), codes)
    codes = np.where(inside, codes, np.uint64(_PAD))
    one = codes[inside]
    pair = inside[:-1] | inside[1:]
    two = ((codes[:-1] << np.uint64(16)) | codes[1:])[pair]
    mid = inside[1:-1]
    three = ((codes[:-2] << np.uint64(32)) | (codes[1:-1] << np.uint64(16)) | codes[2:])[mid]
    high = row << np.uint64(48)
    keys = np.concatenate([high[inside] | one, high[:-1][pair] | two, high[:-2][mid] | three])
    keys.sort()
    return keys, letter[: len(texts)]


def gram_text(gram: int) -> str:
    """The letters of an n-gram; a word's edge reads as ``_``."""
    parts = [(gram >> shift) & 0xFFFF for shift in (32, 16, 0)]
    return "".join("_" if p == _PAD else chr(p) for p in parts if p)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, limit = 0, HELD_GRAMS

    def merged():
        key = np.concatenate([k for k, _ in held])
        n = np.concatenate([c for _, c in held])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        start, _ = runs(key)
        return key[start], np.add.reduceat(n, start)

    for batch in batches:
        for lo, hi in slices(batch.column(0), SLICE):
            part = batch.slice(lo, hi - lo)
            langs = part.column(1).to_pylist()
            for lang in langs:
                names.setdefault(lang, len(names))
            keys, _ = ngrams(part.column(0).to_pylist())
            code = np.array([names[lang] for lang in langs], np.uint64)
            keys = (code[(keys >> np.uint64(48)).astype(np.int64)] << np.uint64(48)) | (
                keys & np.uint64((1 << 48) - 1)
            )
            keys.sort()
            start, n = runs(keys)
            if len(start):
                held.append((keys[start], n))
                size += len(start)
            if size > limit:
                held = [merged()]
                size = len(held[0][0])
                limit = max(HELD_GRAMS, 2 * size)
    if not held:
        return
    key, n = merged()
    by_code = np.array(list(names), object)
    for lo in range(0, len(key), 100_000):
        k = key[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(by_code[(k >> np.uint64(48)).astype(np.int64)], pa.string()),
                pa.array((k & np.uint64((1 << 48) - 1)).astype(np.int64)),
                pa.array(n[lo : lo + 100_000].astype(np.int64)),
            ],
            names=["lang", "gram", "n"],
        )


def learn_profiles(
    docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE
) -> DataFrame:
    """``lang``, ``gram``, ``n`` and ``rank`` (from 0) of each language's ``size`` best n-grams."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        "text is not null and lang is not null"
    )
    counted = (
        rows.mapInArrow(_count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (
        counted.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= size)
        .withColumn("rank", F.col("rank") - 1)
    )


def classifier(profiles: list, size: int = PROFILE_SIZE):
    """Arrow function of a text column; ``profiles`` are rows of ``learn_profiles``."""
    langs = sorted({row["lang"] for row in profiles})
    grams = np.array(sorted({row["gram"] for row in profiles}), np.uint64)
    ranks = np.full((len(grams) + 1, len(langs)), -1, np.int32)
    for row in profiles:
        ranks[np.searchsorted(grams, np.uint64(row["gram"])), langs.index(row["lang"])] = row["rank"]

    def predict(texts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, letter = ngrams(texts)
        best = np.full(len(texts), -1)
        score = np.zeros(len(texts))
        if not langs or not len(keys):
            return best, score
        start, n = runs(keys)
        keys = keys[start]
        row = (keys >> np.uint64(48)).astype(np.int64)
        order = np.argsort((row << 40) + ((1 << 36) - n), kind="stable")
        keys, row = keys[order], row[order]
        first, count = runs(row)
        rank = np.arange(len(row)) - np.repeat(first, count)
        keep = rank < size
        keys, row, rank = keys[keep], row[keep], rank[keep]
        gram = keys & np.uint64((1 << 48) - 1)
        at = np.searchsorted(grams, gram)
        at[(at < len(grams)) & (grams[np.minimum(at, len(grams) - 1)] != gram)] = len(grams)
        theirs = ranks[at]
        apart = np.where(theirs < 0, size, np.abs(theirs - rank[:, None]))
        first, count = runs(row)
        distance = np.add.reduceat(apart, first, axis=0)
        chosen = np.argmin(distance, axis=1)
        who = row[first]
        best[who] = chosen
        score[who] = 1 - distance[np.arange(len(who)), chosen] / (count * size)
        best[~letter], score[~letter] = -1, 0
        return best, score

    names = np.array([*langs, UNKNOWN], object)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            lang, score = [], []
            for lo, hi in slices(column, SLICE):
                best, s = predict(column.slice(lo, hi - lo).to_pylist())
                lang.append(names[best])
                score.append(s)
            lang = pa.array(np.concatenate(lang) if lang else [], pa.string())
            score = pa.array(np.clip(np.concatenate(score), 0, 1) if score else [], pa.float64())
            yield pa.StructArray.from_arrays([lang, score], ["lang_pred", "score"])

    return run


def identify(
    docs: DataFrame, profiles: DataFrame, text: str = "text", size: int = PROFILE_SIZE
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (1: all n-grams at the profile's ranks)."""
    run = classifier(profiles.select("lang", "gram", "rank").collect(), size)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(columns)

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    found = f"{free_prefix(docs)}found"
    return docs.withColumn(found, predict(F.col(f"`{text}`"))).select(
        *kept, f"{found}.lang_pred", f"{found}.score"
    )
