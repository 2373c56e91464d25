"""Interning of byte spans in one open-addressed NumPy table.

Keys are xxhash64 of a span's bytes; a slot belongs to a span only if the bytes agree too, so two
spans with one key lie in two slots. All spans of a batch step through the table together: in every
round each one looks at one slot, claims it if it is free, and goes on to the next if other bytes
hold it. Equal spans look at the same slots in the same rounds, so they always end in the same one.
"""

from __future__ import annotations

import numpy as np

# the five primes of xxhash64
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )
)
_LANES = np.array([_P1, _P2, 0, 0], np.uint64) + np.array([_P2, 0, 0, ~_P1 + np.uint64(1)], np.uint64)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(lane: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _turn(lane + value * _P2, 31) * _P1


class Spans:
    """Byte spans ``start`` to ``end`` of one buffer."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.start, self.size = start.astype(np.int64), (end - start).astype(np.int64)
        # every 8 bytes that begin at any place, as one number
        self._padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self._eight = np.ndarray(len(data) + 1, "<u8", self._padded, 0, (1,))

    def _read(self, at: np.ndarray, count: int = 8) -> np.ndarray:
        return self._eight[at] & np.uint64((1 << (8 * count)) - 1)

    def bytes_of(self, span: int) -> memoryview:
        return memoryview(self._padded)[self.start[span] : self.start[span] + self.size[span]]

    def keys(self) -> np.ndarray:
        """xxhash64 with seed 0 of every span."""
        at, left = self.start.copy(), self.size.copy()
        h = np.full(len(at), _P5)
        long = np.flatnonzero(left >= 32)
        if len(long):
            lanes = np.empty((4, len(long)), np.uint64)
            lanes[:] = _LANES[:, None]
            going = np.arange(len(long))
            while len(going):
                of = long[going]
                for k in range(4):
                    lanes[k, going] = _round(lanes[k, going], self._read(at[of] + 8 * k))
                at[of] += 32
                left[of] -= 32
                going = going[left[of] >= 32]
            total = sum(_turn(lane, bits) for lane, bits in zip(lanes, (1, 7, 12, 18), strict=True))
            for lane in lanes:
                total = (total ^ _round(np.zeros_like(lane), lane)) * _P1 + _P4
            h[long] = total
        h += self.size.astype(np.uint64)
        for width in (8, 4, 1):
            while len(some := np.flatnonzero(left >= width)):
                word = self._read(at[some], width)
                if width == 8:
                    h[some] = _turn(h[some] ^ _round(np.zeros_like(word), word), 27) * _P1 + _P4
                elif width == 4:
                    h[some] = _turn(h[some] ^ word * _P1, 23) * _P2 + _P3
                else:
                    h[some] = _turn(h[some] ^ word * _P5, 11) * _P1
                at[some] += width
                left[some] -= width
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the spans numbered ``a`` hold the same bytes as those numbered ``b``."""
        same = self.size[a] == self.size[b]
        done, open_ = 0, np.flatnonzero(same)
        while len(open_):
            left = self.size[a[open_]] - done
            mask = np.where(left >= 8, 0, np.minimum(left, 8) * 8).astype(np.uint64)
            mask = np.where(mask == 0, ~np.uint64(0), (np.uint64(1) << mask) - np.uint64(1))
            mask = np.where(left == 0, np.uint64(0), mask)
            x = self._eight[self.start[a[open_]] + done] & mask
            y = self._eight[self.start[b[open_]] + done] & mask
            same[open_[x != y]] = False
            open_ = open_[(x == y) & (left > 8)]
            done += 8
        return same


def intern(spans: Spans, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every span, and the span that opened each slot (-1: a free slot).

    The table has twice as many slots as spans, or more, so a free one is always found.
    """
    n = len(spans.start)
    size = 1 << max(4, (2 * n).bit_length())
    key = spans.keys() if keys is None else keys
    opened_by = np.full(size, -1, np.int64)
    slot = np.empty(n, np.int64)
    at = (key & np.uint64(size - 1)).astype(np.int64)
    going = np.arange(n)
    while len(going):
        here = at[going]
        free = opened_by[here] < 0
        opened_by[here[free]] = going[free]  # of several claimants the last one stays
        owner = opened_by[here]
        same = key[owner] == key[going]
        other = np.flatnonzero(same & (owner != going))
        same[other] = spans.equal(owner[other], going[other])
        slot[going[same]] = here[same]
        going = going[~same]
        at[going] = (at[going] + 1) & (size - 1)
    return slot, opened_by
