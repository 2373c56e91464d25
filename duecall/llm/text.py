"""Vectorised work on Arrow text columns: words, hashes and groups over whole batches at once.

A batch is cut into slices of about ``SLICE_BYTES`` of text, which bounds the memory of a task; a
single text longer than that makes a slice of its own. Nothing here drops or shortens a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_WORD_BYTE = ~_SPACE
# letters, digits and every byte of a non-ASCII character
TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each."""
    _, offsets = flat(column)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), len(column), start + 60_000)
        yield start, stop
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), where - where[0]
    return np.frombuffer(data, np.uint8)[where[0] : where[-1]], where - where[0]


def words(
    data: np.ndarray, offsets: np.ndarray, of: np.ndarray = _WORD_BYTE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of the bytes ``of``: no blanks, tabs or line ends."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = of[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(offsets))
    first[offsets[filled]] = inside[offsets[filled]]
    last[offsets[filled + 1] - 1] = inside[offsets[filled + 1] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal spans have equal hashes in every task."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, a place of each, and for every hash its number among them."""
    order = np.argsort(hashes)
    start, count = runs(hashes[order])
    number = np.empty(len(hashes), np.int64)
    number[order] = np.repeat(np.arange(len(start)), count)
    return hashes[order[start]], order[start], number


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def shingles_at(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the run of ``size`` words from every word on, and whether the row has that many."""
    n = len(hashes)
    end = np.searchsorted(row, row, "right")
    total = np.zeros(n, np.uint64)
    for k in range(size):
        part = np.zeros(n, np.uint64)
        if k < n:
            part[: n - k] = hashes[k:]
        total = mix(total * np.uint64(0x2545F4914F6CDD1D) + part)
    return total, np.arange(n) + size <= end


def shingles(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``size`` words; a row with fewer words has one run of all."""
    total, whole = shingles_at(hashes, row, size)
    start, count = runs(row)
    few = start[count < size]
    if len(few):
        # all words of a short row, folded as in a longer run
        size_of = count[count < size]
        short = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            part = hashes[np.minimum(few + k, len(hashes) - 1)]
            more = k < size_of
            short[more] = mix(short[more] * np.uint64(0x2545F4914F6CDD1D) + part[more])
        total[few], whole[few] = short, True
    return total[whole], row[whole]


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal neighbours, and its length."""
    if not len(key):
        none = np.zeros(0, np.int64)
        return none, none
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return start, np.diff(np.append(start, len(key)))


def uniform(seed: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each 64-bit seed."""
    return ((mix(seed) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
