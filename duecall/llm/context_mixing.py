"""Language-model scores by logistic context mixing.

A token (a lower-cased word, or the end of a text, which is the empty word) is coded as its bytes
and a blank, bit by bit. Four predictors know the last one, two or three bytes of the word or all of
it so far; each looks up, under its context and the bits of the byte so far, how often the bit was
0 or 1 in the training texts. Their predictions are stretched to the logistic domain
and added with weights chosen by a gate: how often the two longest contexts were seen. The weights
are learned online, over the training words in batches, each word without one of its own
occurrences. Within a text the result is refined as the text goes on: words seen before in it
become likelier, and those that followed the previous word before still more, in several strengths,
and the strengths are weighed by how well they did so far. So the order of words counts, but which
word follows which is learned from the text at hand alone: pairs of words counted over the corpus
would need more shuffled data than the corpus itself.

All statistics come from all training texts. Texts become lists of word numbers in chunks of about
``CHUNK_BYTES``, each with its own list of distinct words; the words meet the vocabulary in one
join, so every word is modelled once, not once per occurrence, and a word in every text is one row
per chunk. What the join finds goes back to the chunks in packed columns.

Counts are Spark rows, one per context and byte, and grow with the input: a context is known by 55
bits of hash, so contexts do not share counts. The sorted vocabulary is cut into blocks of about
``BLOCK_BYTES``; rows of equal contexts meet in one shuffle, where the bytes of a context give the
counts of all its bits, and those go back to the blocks that need them.

Cases: a null text counts as empty and is just an end. Blanks, tabs and line ends divide words;
words may be of any length. Without training texts every bit has probability one half. Repeated
rows are counted and scored each. Null keys belong to the fold of the empty text. Columns of the
input other than key and text are not carried on.
"""

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecall.llm.shared import saved
from duecall.llm.text import distinct, flat, lower_ascii, mix, runs, slices, span_hashes, words

SLOT_BITS = 55  # of hash per context; a byte follows in the key
BLOCK_BYTES = 1 << 20
CHUNK_BYTES = 24 << 20
PACKED_ROWS = 1 << 18
TEXTS = 64  # scored together
CONTEXTS = 4
STRENGTHS = (2.0, 10.0, 50.0, 250.0)
# of the previous word's followers, on top of each of these
PAIR_STRENGTHS = (1.0, 8.0)
PAIRED = (10.0, 50.0)
HEADS = (2, 4)  # bytes of a word's beginnings that texts adapt to
_LEVELS = np.array([1, 3, 10, 100])
GATES = (len(_LEVELS) + 1) ** 2
_END = 0x20


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of about ``limit`` bytes of text; a longer text comes alone."""
    parts, size = [], 0
    for batch in batches:
        _, offsets = flat(batch.column(1))
        for lo, hi in slices(batch.column(1), limit):
            more = int(offsets[hi] - offsets[lo])
            if parts and size + more > limit:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                parts, size = [], 0
            parts.append(batch.slice(lo, hi - lo))
            size += more
    if parts:
        yield from pa.Table.from_batches(parts).combine_chunks().to_batches()


def _planes(values: np.ndarray) -> bytes:
    """Compressed bytes of numbers, all first bytes first: small numbers then take little room."""
    return zlib.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _chunk_words(column: pa.Array, train: np.ndarray):
    """Every row's word numbers in the list of the chunk's distinct words, the spellings of those,
    and how often training rows have them. Only numbers of four bytes are kept per word."""
    hashes, spelled, often, seen, numbers, counts = [], [], [], [], [], []
    for a, b in slices(column):
        data, at = flat(column.slice(a, b - a))
        data = lower_ascii(data)
        start, end, row = words(data, at)
        different, first, own = distinct(span_hashes(data, start, end))
        raw = data.tobytes()
        spelled += [raw[x:y] for x, y in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        hashes.append(different)
        often.append(np.bincount(own, minlength=len(different)))
        seen.append(np.bincount(own, train[a + row], len(different)))
        numbers.append(own.astype(np.uint32))
        counts.append(np.bincount(row, minlength=b - a))
    every, first, back = distinct(np.concatenate(hashes))
    # frequent words get small numbers, which compress well
    order = np.argsort(-np.bincount(back, np.concatenate(often), len(every)), kind="stable")
    rank = np.empty(len(every), np.uint32)
    rank[order] = np.arange(len(every))
    total = np.bincount(back, np.concatenate(seen), len(every)).astype(np.int64)[order]
    lists, place = [], 0
    for different, own, count in zip(hashes, numbers, counts, strict=True):
        word = rank[back[place : place + len(different)]][own].astype("<u4")
        place += len(different)
        cut = np.cumsum(count)
        lists += [_planes(word[x:y]) for x, y in zip((cut - count).tolist(), cut.tolist(), strict=True)]
    return lists, [spelled[k] for k in first[order].tolist()], total


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts (word numbers, compressed) and rows of their chunk's distinct words."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in _gathered(batches, CHUNK_BYTES):
        n = batch.num_rows
        if n:
            train = ~np.array(batch.column(2).to_pylist(), bool)
            lists, spelled, seen = _chunk_words(batch.column(1), train)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            # the end of a text is the empty word, last of the chunk's list
            spelled.append(b"")
            seen = np.append(seen, train.sum())
            m = len(spelled)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + m, (part << 32) + number)),
                    pa.concat_arrays([batch.column(0), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([batch.column(2), pa.nulls(m, pa.bool_())]),
                    pa.concat_arrays([size, pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(lists, pa.binary()), pa.nulls(m, pa.binary())]),
                    pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.arange(m), pa.int32())]),
                    pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(spelled, pa.binary())]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(seen)]),
                ],
                names=["chunk", "key", "held_out", "n_bytes", "words", "number", "word", "seen"],
            )
            number += 1


_CHUNK = (
    "chunk bigint, key bigint, held_out boolean, n_bytes bigint, words binary, "
    "number int, word binary, seen bigint"
)


class _Coded:
    """The bytes of words, each closed by a blank, with the contexts of every byte."""

    def __init__(self, column: pa.Array):
        data, offsets = flat(column.cast(pa.large_binary()).view(pa.large_string()))
        size = np.diff(offsets) + 1
        first = np.cumsum(size) - size
        self.bytes = np.full(int(size.sum()), _END, np.uint8)
        inside = np.ones(len(self.bytes), bool)
        inside[first + size - 1] = False
        self.bytes[inside] = data
        self.word = np.repeat(np.arange(len(size)), size)
        self.first = first
        start = first[self.word]
        at = np.arange(len(self.bytes))
        self.context = [
            # a context of n bytes does not reach back over the start of the word
            span_hashes(self.bytes, np.maximum(start, at - n), at)
            for n in (1, 2, 3)
        ]
        self.context.append(span_hashes(self.bytes, start, at))

    def keys(self, slot_bits: int) -> list[np.ndarray]:
        """Context and byte as one number, the byte last, for each kind of context."""
        shift = np.uint64(64 - slot_bits)
        return [
            (((mix(c + np.uint64(k)) >> shift) << np.uint64(8)) | self.bytes).astype(np.int64)
            for k, c in enumerate(self.context)
        ]

    def bit(self, bit: int) -> np.ndarray:
        return (self.bytes >> np.uint8(7 - bit)) & np.uint8(1)


def _words_of(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    yield from slices(column.cast(pa.large_binary()).view(pa.large_string()), limit)


def _blocks(slot_bits: int):
    """Rows of the words of a block, and rows of their contexts with how often training saw them."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in _gathered_words(batches):
            words, seen = batch.columns
            keys, counts = [], []
            for lo, hi in _words_of(words, 1 << 18):
                coded = _Coded(words.slice(lo, hi - lo))
                n = seen.to_numpy()[lo:hi][coded.word]
                key, of = np.unique(np.concatenate(coded.keys(slot_bits)), return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, of, np.tile(n, CONTEXTS))
                keys.append(key)
                counts.append(total)
            key, of = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, of, np.concatenate(counts))
            n, m = len(words), len(key)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + m, (part << 32) + number)),
                    pa.concat_arrays([words, pa.nulls(m, pa.binary())]),
                    pa.concat_arrays([seen, pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(key)]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(total)]),
                ],
                names=["block", "word", "seen", "key", "n"],
            )
            number += 1

    return blocks


def _gathered_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of about ``BLOCK_BYTES``; a longer word comes alone."""
    parts, size = [], 0
    for batch in batches:
        for lo, hi in _words_of(batch.column(0), BLOCK_BYTES):
            part = batch.slice(lo, hi - lo)
            more = int(pc.sum(pc.binary_length(part.column(0))).as_py() or 0)
            if parts and size + more > BLOCK_BYTES:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                parts, size = [], 0
            parts.append(part)
            size += more
    if parts:
        yield from pa.Table.from_batches(parts).combine_chunks().to_batches()


_SUMS = 9
_COUNTED = ("<i8", *("<i8" for _ in range(_SUMS)))


def _node_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, key, n) ordered by key, with the counts of the key's context followed by the
    first 0 to 8 bits of its byte. A context's last rows wait until the next context begins."""

    def summed(block: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        sums = []
        for bits in range(_SUMS):
            start, count = runs(key >> (8 - bits))
            sums.append(np.repeat(np.add.reduceat(n, start), count))
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (block, key, *sums)],
            names=["block", "key", *(f"s{k}" for k in range(_SUMS))],
        )

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
        if not len(rows[1]):
            continue
        context = rows[1] >> 8
        cut = int(np.searchsorted(context, context[-1]))
        if cut:
            yield summed(*(r[:cut] for r in rows))
        held = [r[cut:] for r in rows]
    if len(held[1]):
        yield summed(*held)


def block_counts(vocabulary: DataFrame, slot_bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame]:
    """``block``, ``word``, ``seen`` of every word, and ``of_chunk``, ``packed``: for each block the
    counts of every context and byte its words have."""
    least = vocabulary.sparkSession.sparkContext.defaultParallelism
    tasks = max(least, math.ceil(vocabulary.count() / 100_000))
    ordered = vocabulary.select("word", "seen").repartitionByRange(tasks, "word")
    blocks = saved(
        ordered.sortWithinPartitions("word").mapInArrow(
            _blocks(slot_bits), "block bigint, word binary, seen bigint, key bigint, n bigint"
        ),
        "blocks",
    )
    counted = (
        blocks.where("key is not null")
        .select("block", "key", "n")
        .withColumn("context", F.shiftright("key", 8))
        .repartition("context")
        .drop("context")
        .sortWithinPartitions("key")
        .mapInArrow(lambda rows: _packer(_COUNTED)(_node_sums(rows)), "of_chunk bigint, packed array<binary>")
    )
    return blocks.where("word is not null").select("block", "word", "seen"), saved(counted, "counts")


def _level(total: np.ndarray) -> np.ndarray:
    return sum((total >= n).astype(np.uint8) for n in _LEVELS)


def _gate(levels: list[np.ndarray]) -> np.ndarray:
    return levels[3].astype(np.int64) * (len(_LEVELS) + 1) + levels[2]


def _stretched(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.clip(np.log((one + np.float32(0.02)) / (zero + np.float32(0.02))), -12, 12)


class _Counts:
    """What the contexts of a block predict, from their counts."""

    def __init__(self, packed: list[list[bytes]], slot_bits: int):
        self.slot_bits = slot_bits
        key, *sums = _unpacked(packed, _COUNTED)
        self.key, first = np.unique(key, return_index=True)
        self.sums = [s[first].astype(np.float32) for s in sums]
        self.level = [_level(s) for s in self.sums[:-1]]
        # towards the bit that the key's byte has
        self.stretched = [_stretched(a - b, b) for a, b in zip(self.sums[:-1], self.sums[1:], strict=True)]

    def inputs(self, coded: _Coded, bit: int, leave: bool):
        """Stretched predictions, gate and bit of every byte; with ``leave`` without one occurrence."""
        if not hasattr(coded, "places"):
            coded.places = [np.searchsorted(self.key, k) for k in coded.keys(self.slot_bits)]
        y = coded.bit(bit)
        sign = y.astype(np.float32) * 2 - 1
        stretched, levels = [], []
        for at in coded.places:
            if leave:
                total, same = self.sums[bit][at], self.sums[bit + 1][at]
                left = np.maximum(same - 1, 0)
                stretched.append(sign * _stretched(total - same, left))
                levels.append(_level(total - same + left))
            else:
                stretched.append(sign * self.stretched[bit][at])
                levels.append(self.level[bit][at])
        return np.stack(stretched), _gate(levels), y


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _first_weights() -> np.ndarray:
    """Trust in the longest context grows with how often it was seen; what is left goes down."""
    trust = np.array([0.0, 0.3, 0.5, 0.8, 0.95])
    weights = np.zeros((len(trust), len(trust), CONTEXTS))
    weights[..., 3] = trust[:, None]
    weights[..., 2] = (1 - trust)[:, None] * trust
    left = (1 - trust)[:, None] * (1 - trust)
    weights[..., 1], weights[..., 0] = 0.7 * left, 0.3 * left
    return np.repeat(weights.reshape(GATES, CONTEXTS), 8, axis=0)


def learn_weights(
    words_of: DataFrame, counts: DataFrame, slot_bits: int = SLOT_BITS, rate: float = 0.03
) -> np.ndarray:
    """A weight per gate, bit and context. Every block of ``block_counts`` learns online over its
    words, in mixed order; the mean of the blocks, weighted by what they saw, is taken."""

    def learn(words: pa.Table, packed: pa.Table) -> pa.Table:
        table = _Counts(packed["packed"].to_pylist(), slot_bits)
        weights = _first_weights()
        steps = np.full(weights.shape, 1e-4)
        seen = np.zeros(GATES * 8)
        words = words.filter(pc.greater(words["seen"], 0)).sort_by("word")
        words = words.take(np.random.default_rng(0).permutation(len(words))).combine_chunks()
        for batch in words.to_batches():
            word, count = batch.column("word"), batch.column("seen").to_numpy()
            for lo, hi in _words_of(word, 1 << 15):
                coded = _Coded(word.slice(lo, hi - lo))
                c = count[lo:hi][coded.word].astype(float)
                for bit in range(8):
                    x, gate, y = table.inputs(coded, bit, True)
                    gate = gate * 8 + bit
                    error = (y - _squash((weights[gate].T * x).sum(axis=0))) * c
                    mass = np.bincount(gate, c, GATES * 8)
                    pull = np.stack([np.bincount(gate, error * k, GATES * 8) for k in x], axis=1)
                    pull /= np.maximum(mass, 1)[:, None]
                    steps += pull * pull
                    weights += rate * pull / np.sqrt(steps)
                    seen += mass
        used = np.flatnonzero(seen)
        return pa.table(
            {
                "gate": pa.array(used),
                "mass": pa.array(seen[used]),
                **{f"w{k}": pa.array(weights[used, k]) for k in range(CONTEXTS)},
            }
        )

    schema = "gate bigint, mass double, " + ", ".join(f"w{k} double" for k in range(CONTEXTS))
    parts = words_of.groupBy("block").cogroup(counts.groupBy("of_chunk")).applyInArrow(learn, schema)
    means = [(F.sum(F.col(f"w{k}") * F.col("mass")) / F.sum("mass")).alias(f"w{k}") for k in range(CONTEXTS)]
    weights = _first_weights()
    for row in parts.groupBy("gate").agg(*means).collect():  # one row per gate and bit
        weights[row["gate"]] = [row[f"w{k}"] for k in range(CONTEXTS)]
    return weights


def word_logs(column: pa.Array, table: _Counts, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log of the probability of each word's first bytes (a column per entry of ``HEADS``,
    the closing blank included) and of the whole word; and the word's first four bytes as a number."""
    out = np.zeros((len(column), len(HEADS) + 1))
    heads = np.zeros(len(column), np.uint32)
    weights = weights.astype(np.float32)
    for lo, hi in _words_of(column, 1 << 18):
        coded = _Coded(column.slice(lo, hi - lo))
        total = np.zeros(len(coded.bytes))
        for bit in range(8):
            x, gate, y = table.inputs(coded, bit, False)
            score = np.einsum("nk,kn->n", weights[gate * 8 + bit], x)
            # the log of the logistic of the score, or of its opposite
            total -= np.log1p(np.exp(np.clip(np.where(y == 1, -score, score), -20, 20)))
        place = np.arange(len(total)) - coded.first[coded.word]
        for k, head in enumerate(HEADS):
            out[lo:hi, k] = np.bincount(coded.word, np.where(place < head, total, 0.0), hi - lo)
        out[lo:hi, -1] = np.add.reduceat(total, coded.first)
        at = np.flatnonzero(place < max(HEADS))
        shifted = coded.bytes[at].astype(np.uint32) << (8 * place[at]).astype(np.uint32)
        np.bitwise_or.at(heads, lo + coded.word[at], shifted)
    return out, heads


def _seen_before(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each key occurred before in its row."""
    n = len(key)
    if not n:
        return np.zeros(0)
    wide, low = int(key.max()).bit_length(), n.bit_length()
    if int(row.max()).bit_length() + wide + low > 63:
        _, key = np.unique(key, return_inverse=True)
        both = (row << 32) | key
        order = np.argsort(both, kind="stable")
        both = both[order]
    else:
        # with its place in the lowest bits a key needs no stable sort, which takes far longer
        both = (((row << wide) | key) << low) | np.arange(n)
        both.sort()
        order = both & ((1 << low) - 1)
        both >>= low
    start, count = runs(both)
    before = np.empty(n)
    before[order] = np.arange(n) - np.repeat(start, count)
    return before


def _adapted(word: np.ndarray, at: np.ndarray, keys: list, logs: np.ndarray) -> np.ndarray:
    """Log probability of each text (words ``at[i]`` to ``at[i + 1]``).

    A word is its first bytes, more of them, and the whole: each step given the one before has the
    model's probability, refined by how often the text took that step so far. What comes out is
    refined once more by how often the word followed the one before it.
    """
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    above = np.arange(len(word)) - at[row]
    counts = [above, *(_seen_before(key[word], row) for key in keys)]
    before = np.concatenate(([0], word[:-1])) + 1
    before[at[:-1][np.diff(at) > 0]] = 0
    pair = before * (len(logs) + 1) + word
    followed, followers = _seen_before(pair, row), _seen_before(before, row)
    never = followed == 0
    logs = logs[word].T
    experts = [np.bincount(row, logs[-1], len(at) - 1)]
    # a new step's chance may be too small for a number: its log is at hand
    chances, fresh = [], np.zeros(len(word))
    for k, step in enumerate(np.diff(logs, axis=0, prepend=0.0)):
        new = counts[k + 1] == 0
        chances.append(np.where(new, 1.0, np.exp(step)))
        fresh += np.where(new, step, 0.0)
    for strength in STRENGTHS:
        taken, of = np.ones(len(word)), np.ones(len(word))
        for k, chance in enumerate(chances):
            taken *= counts[k + 1] + strength * chance
            of *= counts[k] + strength
        total = np.log(taken / of) + fresh
        experts.append(np.bincount(row, total, len(at) - 1))
        if strength not in PAIRED:
            continue
        chance = np.where(never, 1.0, np.exp(total))
        for more in PAIR_STRENGTHS:
            mixed = np.log((followed + more * chance) / (followers + more)) + np.where(never, total, 0.0)
            experts.append(np.bincount(row, mixed, len(at) - 1))
    # weighing by success so far, from equal weights on, multiplies out to the mean of the products
    stacked = np.stack(experts)
    top = stacked.max(axis=0)
    return top + np.log(np.exp(stacked - top).mean(axis=0))


_PACKED = ("<u4", "<i8", "<u4", *("<f4" for _ in range(len(HEADS) + 1)))


def _packer(kinds: tuple[str, ...]):
    """Rows of a chunk or block, its number first, in packed columns: a row per chunk for every
    ``PACKED_ROWS`` rows read."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        chunk, *columns = (c.to_numpy() for c in pa.Table.from_batches(parts).columns)
        order = np.argsort(chunk, kind="stable")
        columns = [c[order].astype(kind) for c, kind in zip(columns, kinds, strict=True)]
        start, count = runs(chunk[order])
        rows = [
            [_planes(c[a : a + n]) for c in columns]
            for a, n in zip(start.tolist(), count.tolist(), strict=True)
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(chunk[order][start]), pa.array(rows, pa.list_(pa.binary()))],
            names=["of_chunk", "packed"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            parts.append(batch)
            size += batch.num_rows
            if size >= PACKED_ROWS:
                yield packed(parts)
                parts, size = [], 0
        if size:
            yield packed(parts)

    return pack


def _unpacked(rows: list[list[bytes]], kinds: tuple[str, ...]) -> list[np.ndarray]:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return [
        np.concatenate([np.zeros(0, kind), *(_from_planes(x, kind) for x in c)])
        for c, kind in zip(columns, kinds, strict=True)
    ]


_SCORED = (
    "key bigint, held_out boolean, n_tokens bigint, n_known bigint, n_bytes bigint, "
    "base_score double, score double"
)


def _scorer(unseen: float):
    """``unseen``: log10 of N + V + 1."""

    def score(texts: pa.Table, vocabulary: pa.Table) -> pa.Table:
        number, seen, heads, *found_logs = _unpacked(vocabulary["packed"].to_pylist(), _PACKED)
        size = len(number)
        count, logs = np.zeros(size), np.zeros((size, len(HEADS) + 1))
        head = np.zeros(size, np.int64)
        count[number], head[number] = seen, heads
        for k, values in enumerate(found_logs):
            logs[number, k] = values
        keys = [head & ((1 << 8 * n) - 1) for n in HEADS] + [np.arange(size)]
        columns: list[list] = [[] for _ in range(4)]
        lists = texts["words"].to_pylist()
        for lo in range(0, len(lists), TEXTS):
            # the end of a text is the last word of the chunk's list
            found = [
                np.append(_from_planes(x, "<u4"), np.uint32(size - 1)).astype(np.int64)
                for x in lists[lo : lo + TEXTS]
            ]
            at = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            word = np.concatenate(found)
            base = np.add.reduceat(np.log10(count + 1)[word], at[:-1]) - unseen * np.diff(at)
            known = np.add.reduceat((count > 0)[word].astype(np.int64), at[:-1])
            adapted = _adapted(word, at, keys, logs) / math.log(10)
            for column, part in zip(columns, (np.diff(at), known, base, adapted), strict=True):
                column.append(part)
        n, known, base, adapted = (np.concatenate(c) if c else np.zeros(0) for c in columns)
        return pa.table(
            {
                "key": texts["key"],
                "held_out": texts["held_out"],
                "n_tokens": pa.array(n.astype(np.int64)),
                "n_known": pa.array(known.astype(np.int64)),
                "n_bytes": texts["n_bytes"],
                "base_score": pa.array(base),
                "score": pa.array(adapted),
            }
        )

    return score


def score_texts(
    docs: DataFrame, held_out, text: str = "text", key: str = "doc_id", slot_bits: int = SLOT_BITS
) -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one
    unigrams), ``score`` (both log10 probabilities) and ``bits_per_byte`` of every text; the model
    learns from the rows where the column ``held_out`` is false."""
    rows = docs.select(
        F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), held_out.alias("held_out")
    )
    chunked = saved(rows.mapInArrow(_chunks, _CHUNK), "chunks")
    listed = chunked.where("word is not null").select("chunk", "number", "word", "seen")
    vocabulary = saved(listed.groupBy("word").agg(F.sum("seen").alias("seen")), "vocabulary")
    train, distinct = vocabulary.agg(
        F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum(F.expr("int(seen > 0)")), F.lit(0))
    ).first()
    context = docs.sparkSession.sparkContext
    words_of, counts = block_counts(vocabulary, slot_bits)
    # of fixed size: four weights per gate and bit
    weights = context.broadcast(learn_weights(words_of, counts, slot_bits))

    log_names = [f"log_{k}" for k in range(len(HEADS) + 1)]

    def logs(words: pa.Table, packed: pa.Table) -> pa.Table:
        column = words["word"].combine_chunks()
        found, heads = word_logs(column, _Counts(packed["packed"].to_pylist(), slot_bits), weights.value)
        columns = [pa.array(heads.astype(np.int64)), *(pa.array(x.astype(np.float32)) for x in found.T)]
        return pa.table([column, words["seen"], *columns], ["word", "seen", "head", *log_names])

    modelled = saved(
        words_of.groupBy("block")
        .cogroup(counts.groupBy("of_chunk"))
        .applyInArrow(
            logs,
            "word binary, seen bigint, head bigint, " + ", ".join(f"{x} float" for x in log_names),
        ),
        "modelled",
    )
    looked_up = (
        listed.drop("seen")
        .join(modelled, "word")
        .select("chunk", "number", "seen", "head", *log_names)
        .mapInArrow(_packer(_PACKED), "of_chunk bigint, packed array<binary>")
    )
    texts = chunked.where("words is not null").select("chunk", "key", "held_out", "n_bytes", "words")
    scored = (
        texts.groupBy("chunk")
        .cogroup(looked_up.groupBy("of_chunk"))
        .applyInArrow(_scorer(math.log10(train + distinct + 1)), _SCORED)
    )
    return scored.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(train).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
        (-F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
