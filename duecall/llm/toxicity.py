"""Toxicity scores from a factorization machine over hashed terms.

A text is the set of its lower-cased terms, hashed: runs of letters and digits, and their first 3 to
7 letters, which inflected and compound forms share. The score is the logistic of a bias, a weight per term and, for every pair of terms, the product of their factor
vectors, so a term may matter only in company of another.

Fitting reads all labelled rows. Every term of theirs has a weight and factors, however few rows have
it and whatever it means alone: a group mention whose own toxic share is the average still learns
what it does in company, and a pair of rare terms is learned like one of frequent terms. Both parts
end sparse, as most terms mean nothing. The rows are dealt into shards of a bounded number of rows, a
task fits each for ``MIX_EVERY`` epochs, and every term goes on from what its shards have changed
(iterative parameter mixing); a single shard is fitted in one go. A pair that a shard has in a few
rows only does not outgrow chance there. Tasks add the changes up by blocks of terms; only the model
comes to the driver, at most one column per hash, whatever the input.
Scoring is one narrow pass.

Cases: a null text counts as empty, and an empty text gets the score of the bias. Rows with a null
label or key are not learned from. Without labels of both classes every score is the share of toxic
rows seen (0 without any). Equal terms of different rows are one feature; repeated rows are
learned from as often as they come. Columns of the input named like a result column are replaced.
"""

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecall.llm.shared import LABELLED_BOUND, labelled_rows, likely, saved
from duecall.llm.text import TERM_BYTE, flat, lower_ascii, runs, slices, span_hashes, words

HASH_BITS = 22
PREFIXES = (3, 4, 5, 6, 7)
_PREFIX_SALT = 0x5851F42D4C957F2D
# epochs that shards go on their own
MIX_EVERY = 4


def hashed_terms(
    data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms and their rows, ordered by row; with ``known`` (a flag per hash) only
    those that are known."""
    start, end, row = words(data, offsets, TERM_BYTE)
    data = lower_ascii(data)
    shift = np.uint64(64 - HASH_BITS)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(heads, start)
    heads = np.append(heads, len(data))
    found = [(span_hashes(data, start, end) >> shift, row)]
    for letters in PREFIXES:
        stop = heads[np.minimum(at + letters, len(heads) - 1)]
        long = stop < end
        prefix = span_hashes(data, start[long], stop[long]) ^ np.uint64(_PREFIX_SALT)
        found.append((prefix >> shift, row[long]))
    term, row = (np.concatenate(x) for x in zip(*found, strict=True))
    if known is not None:
        keep = known[term]
        term, row = term[keep], row[keep]
    key = np.sort((row.astype(np.uint64) << np.uint64(HASH_BITS)) | term)
    key = key[runs(key)[0]]
    mask = np.uint64((1 << HASH_BITS) - 1)
    return (key & mask).astype(np.int64), (key >> np.uint64(HASH_BITS)).astype(np.int64)


@dataclass
class Model:
    terms: np.ndarray  # sorted hashed terms
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def find(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known terms, and which of ``term`` are known."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(len(term), bool)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[at] == term
        return at[known], known

    def margins(self, at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias) + np.bincount(row, self.linear[at], n)
        for f in self.factors.T:
            v = f[at]
            out += (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n)) / 2
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        known = np.zeros(1 << HASH_BITS, bool)
        known[self.terms] = True
        for lo, hi in slices(column):
            term, row = hashed_terms(*flat(column.slice(lo, hi - lo)), known)
            out[lo:hi] = self.margins(self.find(term)[0], row, hi - lo)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row's distinct terms in order, as differences, packed; other columns as they are."""
    for batch in batches:
        for lo, hi in slices(batch.column(0)):
            term, row = hashed_terms(*flat(batch.column(0).slice(lo, hi - lo)))
            cut = np.searchsorted(row, np.arange(1, hi - lo))
            lists = [_pack(np.diff(t, prepend=0)) for t in np.split(term, cut)]
            rest = (batch.column(k).slice(lo, hi - lo) for k in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.binary()), *rest], names=["terms", "key", "shard"]
            )


def _pack(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers that are not negative, their first bytes together, then their second ones, and so on."""
    numbers = numbers.astype(kind).reshape(-1)
    return zlib.compress(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), 1)


def _unpack(packed: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


_SHARD = "size binary, terms array<binary>, label binary, shard bigint"
_CHUNK = 1000


def _packed(table: pa.Table, labels: pa.Table) -> pa.Table:
    """One row for a shard: how many terms each of its labelled rows has, the terms of every ``_CHUNK``
    rows one after another, and the labels. None for a shard without such rows."""
    at = pc.index_in(table["key"], value_set=labels["key"].combine_chunks())
    known = at.is_valid()
    label = labels["label"].take(at.filter(known))
    lists, n = table["terms"].filter(known).combine_chunks(), len(label)
    size, chunks = [], []
    for lo in range(0, n, _CHUNK):
        some = [_unpack(x) for x in lists.slice(lo, _CHUNK).to_pylist()]
        size += [len(x) for x in some]
        chunks.append(_pack(np.concatenate(some)))
    label = label.to_numpy().astype("i1").tobytes()
    columns = [
        pa.array([_pack(np.array(size, np.int64))], pa.binary()),
        pa.array([chunks], pa.list_(pa.binary())),
        pa.array([label], pa.binary()),
        labels["shard"].slice(0, 1).combine_chunks().cast(pa.int64()),
    ]
    return pa.table([c.slice(0, 1 if n else 0) for c in columns], names=["size", "terms", "label", "shard"])


def _chunks(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Terms of row ``k``'s chunks, the first of each of their rows, and the labels."""
    size, label = _unpack(batch["size"][k].as_py()), np.frombuffer(batch["label"][k].as_py(), "i1")
    for at, chunk in enumerate(batch["terms"][k]):
        some = slice(at * _CHUNK, (at + 1) * _CHUNK)
        first = np.concatenate(([0], np.cumsum(size[some], dtype=np.int64)))
        # sums may wrap around, their differences do not
        total = np.cumsum(_unpack(chunk.as_py()), dtype=np.uint32)
        before = np.concatenate((np.zeros(1, np.uint32), total))[first[:-1]]
        yield total - np.repeat(before, np.diff(first)), first, label[some]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows per term; terms -1 and -2 stand for all rows and all toxic ones."""
    seen = np.zeros(1 << HASH_BITS, np.int64)
    rows = toxic = 0
    for batch in batches:
        for term, _, label in (x for k in range(batch.num_rows) for x in _chunks(batch, k)):
            rows, toxic = rows + len(label), toxic + int(label.sum())
            np.add.at(seen, term, 1)
    used = np.flatnonzero(seen)
    parts = np.append(used, [-1, -2]), np.append(seen[used], [rows, toxic])
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in parts], names=["term", "seen"])


def _placed(kept: np.ndarray, chunks: Iterator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``kept`` of a shard's known terms, each row's first, and the labels.

    Rows are in the order of their contents, so the fit does not depend on how they were dealt.
    """
    at = np.full(1 << HASH_BITS, -1, "<i4")
    at[kept] = np.arange(len(kept))
    rows, labels = [], []
    for term, first, label in chunks:
        place = at[term]
        known = place >= 0
        edge = np.concatenate(([0], np.cumsum(known)))[first]
        place = place[known]
        rows += [place[lo:hi] for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
        labels.append(label)
    label = np.concatenate(labels)
    crc = [zlib.crc32(x) for x in rows]
    twice = {c for c, n in Counter(crc).items() if n > 1}
    order = sorted(range(len(rows)), key=lambda k: (crc[k], rows[k].tobytes() if crc[k] in twice else b"", label[k]))
    first = np.concatenate(([0], np.cumsum([len(rows[k]) for k in order])))
    return np.concatenate([rows[k] for k in order]), first, label[order].astype(float)


# changes are added up as whole numbers, so their order does not matter
_UNITS = np.array([[1 << 12], [1 << 12], [1 << 20]])
_BLOCK = 1 << 14
_BATCH = 256
_TOGETHER = 16
_RATE, _PAIR_RATE, _START, _PAIR_TERMS = 0.3, 0.15, 0.01, 5.0
_CHANGES = "block bigint, places binary, change binary"
_ADDED = "block bigint, shards binary, change binary"


def _in_units(table: np.ndarray) -> np.ndarray:
    """``_UNITS`` of every row of a state."""
    return _UNITS[np.minimum(np.arange(len(table)), len(_UNITS) - 1)]


def _pack_whole(numbers: np.ndarray) -> bytes:
    """Whole numbers, the sign as the lowest bit, so that small ones have few bytes."""
    return _pack((numbers << 1) ^ (numbers >> 63), "<u8")


def _unpack_whole(packed: bytes) -> np.ndarray:
    numbers = _unpack(packed, "<u8")
    return (numbers >> np.uint64(1)).astype(np.int64) ^ -(numbers & np.uint64(1)).astype(np.int64)


def _start(terms: int, factors: int, bias: float, seed: int) -> np.ndarray:
    """The first state. A state has a column per term and one for the bias behind them. Its rows are the
    pull of the weight and its squares (of the bias: itself and its squares), the squares of the
    factors, and the factors."""
    state = np.zeros((3 + factors, terms + 1), np.float32)
    state[1:3] = 1
    state[3:, :-1] = np.random.default_rng(seed).normal(0, _START, (factors, terms))
    state[0, -1] = bias
    return state


def _sent(state: np.ndarray) -> list[bytes]:
    return [_pack_whole(np.rint(row * unit).astype(np.int64)) for row, unit in zip(state, _in_units(state), strict=True)]


def _linear(pulled: np.ndarray, squares: np.ndarray, least: float) -> np.ndarray:
    over = np.maximum(np.abs(pulled) - least, 0)
    return -np.sign(pulled) * over / (np.sqrt(squares) / _RATE + 1)


def _shard_epochs(terms: bytes, sent: list[bytes], start: tuple, epochs: range, seed: int, least: float, shrink: tuple[float, float]):
    """What ``epochs`` change in the columns of a state that a shard has, in blocks of ``_BLOCK`` places:
    of the state ``sent``, or of that made from ``start`` where none is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.cumsum(_unpack(terms), dtype=np.int64)
        state = _start(len(kept), *start)
        for row, packed, unit in zip(state, sent, _in_units(state), strict=False):
            row[:] = _unpack_whole(packed) / unit
        for batch in batches:
            for k, shard in enumerate(batch["shard"].to_pylist()):
                places, first, y = _placed(kept, _chunks(batch, k))
                local = np.zeros(len(kept) + 1, bool)
                local[places] = local[-1] = True
                used = np.flatnonzero(local)
                number = np.cumsum(local, dtype="<i4") - 1
                places = number[places]
                own = state[:, used]
                rng = np.random.default_rng((seed, shard, epochs.start))
                _descend(own, places, first, y, rng, len(epochs), least, shrink)
                change = np.rint((own - state[:, used]) * _in_units(own)).astype(np.int64)
                block = used // _BLOCK
                head, length = runs(block)
                of = [slice(lo, lo + n) for lo, n in zip(head, length, strict=True)]
                columns = [
                    pa.array(block[head]),
                    pa.array([_pack(np.diff(used[x], prepend=0)) for x in of], pa.binary()),
                    pa.array([_pack_whole(change[:, x]) for x in of], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "places", "change"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """The changes of a block's places added up, and how many shards have each of them."""
    block = table["block"][0].as_py()
    shards, total = np.zeros(_BLOCK, np.int64), np.zeros((0, _BLOCK), np.int64)
    for places, change in zip(table["places"], table["change"], strict=True):
        at = np.cumsum(_unpack(places.as_py()), dtype=np.int64) - block * _BLOCK
        part = _unpack_whole(change.as_py()).reshape(-1, len(at))
        if not len(total):
            total = np.zeros((len(part), _BLOCK), np.int64)
        total[:, at] += part
        shards[at] += 1
    columns = [pa.array([block]), pa.array([_pack(shards)]), pa.array([_pack_whole(total)])]
    return pa.table(columns, names=["block", "shards", "change"])


def _mix_in(found: DataFrame, state: np.ndarray, seen: np.ndarray) -> None:
    """``state`` with the changes of all shards: of factors their mean. Pulls of a term in at most
    ``_TOGETHER`` rows are added up, so that a term which single shards hardly know leaves zero too;
    those of a more frequent one count as of so many rows, or as their mean if that is more."""
    for block in found.groupBy("block").applyInArrow(_added, _ADDED).toArrow().to_pylist():
        here = slice(block["block"] * _BLOCK, min((block["block"] + 1) * _BLOCK, len(seen)))
        n = here.stop - here.start
        mean = 1 / np.maximum(_unpack(block["shards"])[:n], 1)
        total = _unpack_whole(block["change"]).reshape(-1, _BLOCK)[:, :n] / _in_units(state)
        state[:2, here] += total[:2] * np.clip(_TOGETHER / seen[here], mean, 1)
        state[2:, here] += total[2:] * mean


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    label: str = "toxic",
    key: str = "doc_id",
    bound: int = LABELLED_BOUND,
    factors: int = 4,
    epochs: int = 12,
    sparse: float = 30.0,
    shrink: tuple[float, float] = (1.0, 2.0),
    seed: int = 0,
) -> Model:
    """All labelled rows are learned from; more than ``bound`` in shards of about half as many.
    ``sparse``: how much more than chance the errors of a weight must add up to before it leaves zero.
    ``shrink``: factors shrink by so many times the growth that chance gives over a term's rows, and
    that one row gives."""
    known = saved(labelled_rows(labels, label, key), "labels")
    n = known.count()
    shards = ceil(2 * n / bound) if n > bound else 1
    kind = docs.schema[key].dataType.simpleString()
    shard = F.pmod(F.xxhash64(F.lit("shard"), "key"), F.lit(shards)).alias("shard")
    marks = known.select(F.expr(f"try_cast(`{key}` as {kind})").alias("key"), F.expr(f"int({label} = 1)").alias("label"))
    rows = docs.select(F.col(text).alias("text"), F.col(key).alias("key"))
    # rows and labels meet by shard, in the task that packs it: texts are not moved, term lists once
    rows = likely(rows, marks, "key").select("text", "key", shard)
    lists = rows.mapInArrow(_term_lists, f"terms binary, key {kind}, shard bigint").groupBy("shard")
    marked = marks.select("key", "label", shard).groupBy("shard")
    packed = saved(lists.cogroup(marked).applyInArrow(_packed, _SHARD), "shards")
    counted = packed.mapInArrow(_count_terms, "term bigint, seen bigint")
    # at most one row per hash
    counts = counted.groupBy("term").agg(F.sum("seen").alias("seen")).toArrow().sort_by("term")
    term, seen = counts["term"].to_numpy(), counts["seen"].to_numpy()
    every = dict(zip(term[:2].tolist(), seen[:2].tolist(), strict=True))
    toxic = every.get(-2, 0)
    clean = every.get(-1, 0) - toxic
    none = np.zeros(0)
    if not toxic or not clean:
        bias = 40.0 if toxic else -40.0
        return Model(none.astype(np.int64), bias, none, np.zeros((0, factors)))
    kept, seen = term[2:], np.append(seen[2:], toxic + clean)
    start = factors, float(np.log(toxic / clean)), seed
    state, terms = _start(len(kept), *start), _pack(np.diff(kept, prepend=0))
    # a single shard has nobody to wait for
    step = epochs if shards == 1 else MIX_EVERY
    for lo in range(0, epochs, step):
        done = range(lo, min(lo + step, epochs))
        run = _shard_epochs(terms, _sent(state) if lo else [], start, done, seed, sparse, shrink)
        _mix_in(packed.mapInArrow(run, _CHANGES), state, seen)
    linear = _linear(*state[:2, :-1].astype(float), sparse)
    # terms without a weight, whose factors have shrunk to nothing, add nothing to any score
    used = (linear != 0) | (np.abs(state[3:, :-1]) > _START / 100).any(axis=0)
    return Model(kept[used], float(state[0, -1]), linear[used], state[3:, :-1][:, used].T.astype(float))


def _batches(places: np.ndarray, first: np.ndarray, order: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """Per batch of rows: these, the terms they have, in how many rows each, the number of every
    row's every term among those, and where each row's end."""
    found, met, number = [], np.zeros(k, bool), np.empty(k, "<i4")
    for lo in range(0, len(order), _BATCH):
        rows = order[lo : lo + _BATCH]
        long = first[rows + 1] - first[rows]
        edge = np.concatenate(([0], np.cumsum(long)))
        at = places[np.arange(edge[-1]) + np.repeat(first[rows] - edge[:-1], long)]
        met[at] = True
        used = np.flatnonzero(met).astype("<i4")
        met[used] = False
        number[used] = np.arange(len(used))
        at = number[at]
        found.append((rows, used, np.bincount(at, minlength=len(used)).astype("<i4"), at, edge))
    return found


def _descend(state: np.ndarray, places, first, y, rng, epochs, least, shrink) -> None:
    """Mini-batch steps on the logistic loss.

    Linear weights follow the regularised leader: a weight stays zero until the sum of its errors
    passes ``least``. Factors start small and at random, so that pairs can be told apart, and grow
    where the errors of a term's rows agree. They shrink by what such errors come to by chance: over
    all rows of a term, however many, and in one row alone. A row's pairs count as those of
    ``_PAIR_TERMS`` terms, since their number grows with the square of its length.
    """
    size, k = np.diff(first), state.shape[1] - 1
    weight = np.minimum(1, _PAIR_TERMS / np.maximum(size, 1))
    spread = np.bincount(places, np.repeat(weight * weight * size, size), k)
    # every term is in some row
    fall = (shrink[0] * np.sqrt(spread) + shrink[1] * _PAIR_TERMS) / np.bincount(places, minlength=k)
    batches = _batches(places, first, rng.permutation(len(y)), k)
    terms, (bias, bias_squares) = np.ascontiguousarray(state[:, :-1].T), state[:2, -1].astype(float)
    for _ in range(epochs):
        for rows, used, count, at, edge in (batches[b] for b in rng.permutation(len(batches))):
            at, n, long = at.astype(np.intp), len(used), np.diff(edge)
            own = np.ascontiguousarray(terms[used].T)
            (pulled, squares, v_squares), v = own[:3], own[3:]
            linear = _linear(pulled, squares, least)
            sums = np.stack([_row_sums(f[at], edge) for f in v])
            alone = _row_sums((linear - (v * v).sum(axis=0) / 2)[at], edge)
            margin = bias + alone + (sums * sums).sum(axis=0) / 2
            error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[rows]

            bias_squares += error.sum() ** 2
            bias -= _RATE * error.sum() / np.sqrt(bias_squares)
            grad, root = np.bincount(at, np.repeat(error, long), n), np.sqrt(squares)
            squares += grad * grad
            pulled += grad - (np.sqrt(squares) - root) / _RATE * linear

            error *= weight[rows]
            grad = np.stack([np.bincount(at, np.repeat(f * error, long), n) for f in sums])
            grad -= np.bincount(at, np.repeat(error, long), n) * v
            v_squares += (grad * grad).mean(axis=0)
            # chance sums of more rows are larger by the root of their number
            step = _PAIR_RATE / np.sqrt(v_squares * count)
            v[:] = (v - step * grad) / (1 + step * fall[used] * count)
            terms[used] = own.T
    state[:, :-1], state[:2, -1] = terms.T, (bias, bias_squares)


def _row_sums(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` between neighbours of ``edge``."""
    sums, filled = np.zeros(len(edge) - 1), np.diff(edge) > 0
    sums[filled] = np.add.reduceat(values, edge[:-1][filled]) if filled.any() else 0
    return sums


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""

    @F.arrow_udf("double")
    def rate(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(model.score(column))

    return docs.withColumn("score", rate(F.col(f"`{text}`"))).withColumn(
        "predicted", F.expr("int(score >= 0.5)")
    )
