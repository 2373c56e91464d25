"""Benchmark passages in texts, found by SimHash fingerprints of item-sized windows.

A window is as long, in words, as the item it is compared with, and may start at any word; a text
that is shorter than an item is one window of all its words, if it has enough of them. A window's
fingerprint of 256 bits sums, bit by bit, the signs of its word shingles' hashes, each as often as
it occurs. Items and windows within ``RADIUS`` bits are found with a multi-index: fingerprints are
cut into 32 blocks of 8 bits, and of 63 differing bits some block holds at most one, so looking up
every block, give or take a bit, misses none. Candidates are then compared exactly: the weighted
Jaccard similarity of their shingles (five words) must reach the threshold.

At a similarity of 0.8 a window and an item of n shingles differ in at most n / 9 of them (a shorter
text lacks at most n / 5), so a bit
differs with probability below 0.16 and the distance stays under 63 (mean 39, deviation 6) but for
about one pair in 30,000 right at the threshold; windows a word further on are compared as well.
A window without any shingle of an item of its size has similarity 0; it is passed over before
fingerprints are made, which leaves no pair out.

Words are lower-cased runs of letters and digits, so layout and punctuation do not hide a passage.
Items go to the tasks in blocks of at most about ``BLOCK_CHARS`` characters, one block after another.
A benchmark of one block is one scan of the documents. Larger ones are met by a numbered copy of the
documents, block by block, and only rows with matches are written and joined back.

Cases: null texts and items count as empty; an item without a word matches nothing. An item of
fewer than five words is one shingle. Equal items each get their own match. Of equally similar
windows the first counts. Empty tables give no matches. Item ids may repeat or be null.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecall.llm.shared import free_prefix, saved
from duecall.llm.text import TERM_BYTE, flat, lower_ascii, mix, runs, shingles_at, slices
from duecall.llm.text import span_hashes, words

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 63
WORDS64 = 4
BLOCK_CHARS = 8_000_000
_FLAGS = 1 << 22


def _signs(shingle: np.ndarray) -> np.ndarray:
    """One row of 256 signs per shingle hash."""
    parts = [mix(shingle + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(WORDS64)]
    raw = np.stack(parts, axis=1).astype("<u8").view(np.uint8)
    return np.unpackbits(raw, axis=1).astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """32 blocks of 8 bits per row of signed sums; a sum of zero counts as set."""
    return np.packbits(sums >= 0, axis=1)


def _term_hashes(column: pa.Array):
    data, offsets = flat(column)
    start, end, row = words(data, offsets, TERM_BYTE)
    return span_hashes(lower_ascii(data), start, end), row


class Index:
    """Items by size: their shingles, fingerprints and blocks."""

    def __init__(self, ids: list, texts: list):
        hashes, row = _term_hashes(pa.array(texts, pa.string()))
        first, count = runs(row)
        self.ids = ids
        self.by_size: dict[int, dict] = {}
        for size in np.unique(count).tolist():
            items, width = [], min(SHINGLE, size)
            for at in first[count == size].tolist():
                shingle, whole = shingles_at(hashes[at : at + size], np.zeros(size, np.int64), width)
                items.append((int(row[at]), np.sort(shingle[whole])))
            prints = _fingerprints(np.stack([_signs(s).sum(axis=0) for _, s in items]))
            shingle = np.unique(np.concatenate([s for _, s in items]))
            flags = np.zeros(_FLAGS, bool)
            flags[shingle & np.uint64(_FLAGS - 1)] = True
            self.by_size[size] = {
                "width": width,
                "items": items,
                "prints": prints,
                "near": self._near(prints),
                "shingles": shingle,
            }
        self.flags: dict[int, np.ndarray] = {}
        for part in self.by_size.values():
            flags = self.flags.setdefault(part["width"], np.zeros(_FLAGS, bool))
            flags[part["shingles"] & np.uint64(_FLAGS - 1)] = True

    @staticmethod
    def _near(prints: np.ndarray) -> list[dict[int, list[int]]]:
        """Per block, the items whose block equals a value or differs from it in one bit."""
        tables: list[dict[int, list[int]]] = [{} for _ in range(prints.shape[1])]
        for item, blocks in enumerate(prints.tolist()):
            for table, value in zip(tables, blocks, strict=True):
                for other in (value, *(value ^ (1 << bit) for bit in range(8))):
                    table.setdefault(other, []).append(item)
        return tables

    def candidates(self, part: dict, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, item and distance of all pairs within the radius."""
        windows, items = [], []
        distinct, back = np.unique(prints, axis=0, return_inverse=True)
        back = back.reshape(-1)
        for number, blocks in enumerate(distinct.tolist()):
            met = set()
            for table, value in zip(part["near"], blocks, strict=True):
                met.update(table.get(value, ()))
            windows += [number] * len(met)
            items += sorted(met)
        windows, items = np.array(windows, np.int64), np.array(items, np.int64)
        apart = np.unpackbits(distinct[windows] ^ part["prints"][items], axis=1).sum(axis=1)
        close = apart <= RADIUS
        windows, items, apart = windows[close], items[close], apart[close]
        # from distinct fingerprints back to windows
        order = np.argsort(back, kind="stable")
        at = np.searchsorted(back[order], windows)
        many = np.searchsorted(back[order], windows, "right") - at
        spread = np.repeat(np.arange(len(windows)), many)
        inner = np.arange(len(spread)) - np.repeat(np.cumsum(many) - many, many)
        return order[at[spread] + inner], items[spread], apart[spread]

    def find(self, column: pa.Array, least: float) -> list[list[dict]]:
        """Matches of each text: the best window of every item that reaches ``least``."""
        out: list[list[dict]] = [[] for _ in range(len(column))]
        hashes, row = _term_hashes(column)
        if not len(hashes):
            return out
        first, count = runs(row)
        start_of = np.repeat(first, count)
        marked = {}
        for width, flags in self.flags.items():
            shingle, whole = shingles_at(hashes, row, width)
            marked[width] = shingle, np.flatnonzero(whole & flags[shingle & np.uint64(_FLAGS - 1)])
        for size, part in self.by_size.items():
            width = part["width"]
            shingle, hit = marked[width]
            at = np.searchsorted(part["shingles"], shingle[hit])
            hit = hit[part["shingles"][np.minimum(at, len(part["shingles"]) - 1)] == shingle[hit]]
            if not len(hit):
                continue
            # windows of this size that hold such a shingle
            span = size - width + 1
            begin = (hit[:, None] - np.arange(span)).ravel()
            owner = np.repeat(row[hit], span)
            inside = (begin >= np.repeat(start_of[hit], span)) & (begin >= 0)
            begin, owner = begin[inside], owner[inside]
            begin = np.unique(begin[begin + size <= (start_of + np.repeat(count, count))[begin]])
            spans = np.full(len(begin), span)
            # whole texts that are shorter, but not by so much that they cannot reach the threshold
            mine = np.unique(np.searchsorted(first, hit, "right") - 1)
            few = count[mine] - width + 1
            mine = mine[(count[mine] < size) & (few >= least * span)]
            begin = np.concatenate([begin, first[mine]])
            spans = np.concatenate([spans, count[mine] - width + 1])
            best: dict[tuple[int, int], tuple] = {}
            for lo in range(0, len(begin), 4096):
                some = slice(lo, lo + 4096)
                self._compare(part, shingle, begin[some], spans[some], row, least, best)
            for (r, item), (similarity, apart, where, n) in sorted(best.items()):
                out[r].append(
                    {
                        "item_id": self.ids[part["items"][item][0]],
                        "similarity": similarity,
                        "start_word": int(where - start_of[where]),
                        "n_words": int(n + width - 1),
                        "distance": int(apart),
                    }
                )
        return out

    def _compare(self, part, shingle, begin, spans, row, least, best) -> None:
        many = np.repeat(begin - (np.cumsum(spans) - spans), spans)
        places = np.unique(many + np.arange(len(many)))
        sums = np.zeros((len(places) + 1, 64 * WORDS64), np.int32)
        np.cumsum(_signs(shingle[places]), axis=0, out=sums[1:])
        at = np.searchsorted(places, begin)
        # a window's shingles are neighbours among the places
        prints = _fingerprints(sums[at + spans] - sums[at])
        for window, item, apart in zip(*self.candidates(part, prints), strict=True):
            where, n = int(begin[window]), int(spans[window])
            a, b = np.sort(shingle[where : where + n]), part["items"][item][1]
            values, counts = np.unique(a, return_counts=True)
            others, there = np.unique(b, return_counts=True)
            _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
            both = int(np.minimum(counts[i], there[j]).sum())
            similarity = both / (len(a) + len(b) - both)
            if similarity >= least:
                key = (int(row[where]), int(item))
                if key not in best or (-similarity, where) < (-best[key][0], best[key][2]):
                    best[key] = (similarity, apart, where, n)


LEAK = "struct<item_id: bigint, similarity: double, start_word: int, n_words: int, distance: int>"
_LEAK_TYPE = pa.list_(
    pa.struct(
        [
            ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int32()),
            ("n_words", pa.int32()), ("distance", pa.int32()),
        ]
    )
)


def _finder(index_of, least: float):
    @F.arrow_udf(f"array<{LEAK}>")
    def find(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(*index_of.value)
        for column in columns:
            found: list[list[dict]] = []
            for lo, hi in slices(column):
                found += index.find(column.slice(lo, hi - lo), least)
            yield pa.array(found, _LEAK_TYPE)

    return find


def with_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    least: float = SIMILARITY,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
    into: str = "leaks",
) -> DataFrame:
    """``docs`` with ``into``: the items found in each text, with similarity, place and distance."""
    items = benchmark.select(
        F.col(item).cast("bigint").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("t")
    )
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = math.ceil(chars / block_chars)
    block_of = F.pmod(F.xxhash64("id", "t"), F.lit(max(blocks, 1)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != into]
    none = F.expr(f"cast(array() as array<{LEAK}>)")
    if not blocks:
        return docs.select(*kept, none.alias(into))

    def search(number: int):
        """The finder of one block, and what it holds in the tasks."""
        rows = sorted(
            items.where(block_of == number).collect(), key=lambda r: (r["id"] is None, r["id"], r["t"])
        )
        # a block holds about block_chars characters at most, or a single longer item
        held = docs.sparkSession.sparkContext.broadcast(
            ([r["id"] for r in rows], [r["t"] for r in rows])
        )
        # called once per row, whatever is asked of its result
        return _finder(held, least).asNondeterministic(), held

    prefix = free_prefix(docs)
    if blocks == 1:
        found = f"{prefix}leaks"
        return docs.withColumn(found, search(0)[0](F.col(f"`{text}`"))).select(
            *kept, F.col(found).alias(into)
        )
    row, other, leaks = (f"{prefix}{name}" for name in ("row", "other", "leaks"))
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    every = None
    for number in range(blocks):
        find, held = search(number)
        hits = numbered.select(F.col(row).alias(other), find(F.col(f"`{text}`")).alias(leaks))
        hits = saved(hits.where(F.size(leaks) > 0), "leaks")
        held.destroy()
        every = hits if every is None else every.union(hits)
    gathered = every.groupBy(other).agg(F.flatten(F.collect_list(leaks)).alias(leaks))
    joined = numbered.join(gathered, F.col(row) == F.col(other), "left")
    return joined.select(*kept, F.coalesce(leaks, none).alias(into))
