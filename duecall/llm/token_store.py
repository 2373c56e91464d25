"""Token ids of whole texts in files of directly addressable codes.

**Encoding.** Texts are cut into the pre-tokens of a byte-level BPE tokenizer, all texts of a slice
at once; each distinct pre-token is encoded once per Python worker by the tokenizers library, and
an end id closes every text.

**Codes.** An id is split into bytes, lowest first. Level 0 holds the lowest byte of every id and a
bitmap that tells which ids go on; level 1 holds the next byte of those, and so on. The number of
set bits before any position comes from a rank directory (one count per 512 bits) and at most 64
bytes of bitmap, so the token at a position is found from a few bytes of each level, without
decoding its neighbours.

**Files.** Parquet rows, written and committed by Spark: one row is a shard of consecutive
documents in ascending id order, of about ``SHARD_TOKENS`` tokens (a document is never cut, so a
longer one makes a longer shard). A shard knows its write task and the tokens before it in that
task; with the totals of the tasks, one row each, that gives global positions.

Cases: a null text counts as empty and holds only the end id. Null document ids come first; equal
ids are ordered by a hash of their texts, so a key with very many rows is split over tasks. Added
tokens of the tokenizer are found in a text before anything else. An empty table makes an empty store. Other columns of the
input are not stored.
"""

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duecall.llm.text import flat, slices, span_hashes

SHARD_TOKENS = 1 << 20
RANK_BITS = 512
_LEVELS = 4

_SPACE, _LETTER, _NUMBER, _OTHER, _UNSEEN = range(5)
_SPACES = (
    *range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
_class = np.full(0x110000, _UNSEEN, np.uint8)
_class[list(_SPACES)] = _SPACE


def _classes(codes: np.ndarray) -> np.ndarray:
    found = _class[codes]
    if (found == _UNSEEN).any():
        for code in np.unique(codes[found == _UNSEEN]):
            kind = unicodedata.category(chr(code))[0]
            _class[code] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
        found = _class[codes]
    return found


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each pre-token of the byte-level pattern: contractions; runs of
    letters, of numbers, of other signs, each with one blank before it; and white space, of which
    the last character stays for what follows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(codes)
    kind = _classes(codes)
    firsts = np.searchsorted(heads, offsets[:-1][np.diff(offsets) > 0])
    fresh = np.zeros(n + 1, bool)
    fresh[firsts] = fresh[n] = True
    space = kind == _SPACE
    before = np.concatenate(([_OTHER], kind[:-1]))
    begins = np.empty(n, bool)
    next_solid = np.zeros(n, bool)
    next_solid[:-1] = ~space[1:] & ~fresh[1:n]
    after_space = before == _SPACE
    blank_before = np.concatenate(([False], codes[:-1] == 0x20))
    begins = np.where(
        space,
        ~after_space | next_solid,
        np.where(after_space, ~blank_before, kind != before),
    )
    begins |= fresh[:n]
    # contractions: an apostrophe that begins a pre-token, and the letters that belong to it
    mark = np.flatnonzero(begins & (codes == 0x27))
    if len(mark):
        one = np.append(codes, [0, 0])[mark + 1]
        two = np.append(codes, [0, 0])[mark + 2]
        same = ~fresh[mark + 1]
        single = same & np.isin(one, [ord(c) for c in "stmd"])
        double = np.zeros(len(mark), bool)
        for pair in ("re", "ve", "ll"):
            double |= (one == ord(pair[0])) & (two == ord(pair[1]))
        double &= same & ~fresh[np.minimum(mark + 2, n)]
        for chosen, size in ((single, 1), (double, 2)):
            begins[mark[chosen] + 1] = False
            after = mark[chosen] + 1 + size
            begins[after[after < n]] = True
    start = heads[begins]
    end = np.append(start[1:], len(data))
    return start, end, np.searchsorted(offsets, start, "right") - 1


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable ones as they are, the
    rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


def _added_tokens(tokenizer_json: str) -> dict[bytes, int]:
    """Bytes and ids of the tokens that are found in a text before anything else."""
    added = json.loads(tokenizer_json).get("added_tokens") or []
    for token in added:
        if any(token.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token with a rule of its own: {token['content']!r}")
    return {token["content"].encode(): token["id"] for token in added}


class Encoder:
    """Ids of texts; pre-tokens seen before are looked up by their 64-bit hash."""

    MOST = 3_000_000  # pre-tokens held; beyond that the table is started anew

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(tokenizer_json).model
        self.letters = _byte_letters()
        self.added = _added_tokens(tokenizer_json)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes
        self.place = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)  # where each pre-token's ids start, by place
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        raw, letters, tokenize = data.tobytes(), self.letters, self.model.tokenize
        found = [
            [t.id for t in tokenize(raw[s:e].decode("latin-1").translate(letters))]
            for s, e in zip(start.tolist(), end.tolist(), strict=True)
        ]
        size = np.array([len(x) for x in found], np.int64)
        place = len(self.first) - 1 + np.arange(len(found))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        flat_ids = np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))
        self.ids = np.concatenate([self.ids, flat_ids])
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.place = np.insert(self.place, at, place)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and how many each row has.

        Added tokens are found first, leftmost and longest; the texts between them are encoded
        each on its own, as the library does.
        """
        edges, row, added = self._split(data, offsets)
        if not (added >= 0).any():
            return self._encode_plain(data, offsets)
        ids, size = self._encode_plain(data, edges)
        first = np.cumsum(size) - size
        special = np.flatnonzero(added >= 0)
        ids = ids.copy()
        ids[first[special]] = added[special]
        # of the ids of an added token's text only the first place is kept
        keep = np.ones(len(ids), bool)
        keep[np.repeat(added >= 0, size)] = False
        keep[first[special]] = True
        size[special] = 1
        return ids[keep], np.bincount(row, size, len(offsets) - 1).astype(np.int64)

    def _split(self, data: np.ndarray, offsets: np.ndarray):
        """Edges of the pieces that added tokens cut, the row of each, and its id (-1: plain)."""
        raw = data.tobytes()
        edges, rows, ids = [0], [], []

        def piece(upto: int, row: int, token: int) -> None:
            if upto > edges[-1]:
                edges.append(upto)
                rows.append(row)
                ids.append(token)

        if self.added and any(token in raw for token in self.added):
            pattern = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
            for k in range(len(offsets) - 1):
                for found in pattern.finditer(raw, int(offsets[k]), int(offsets[k + 1])):
                    piece(found.start(), k, -1)
                    piece(found.end(), k, self.added[found.group()])
                piece(int(offsets[k + 1]), k, -1)
        return np.array(edges, np.int64), np.array(rows, np.int64), np.array(ids, np.int64)

    def _encode_plain(
        self, data: np.ndarray, offsets: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        start, end, row = pre_tokens(data, offsets)
        rows = len(offsets) - 1
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        hashes = span_hashes(data, start, end)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.MOST:
            self.clear()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if new.any():
            self._learn(distinct[new], data, start[first[new]], end[first[new]])
            at = np.searchsorted(self.known, distinct)
        place = self.place[at][back]
        size = self.first[place + 1] - self.first[place]
        total = np.cumsum(size)
        where = np.repeat(self.first[place] - (total - size), size) + np.arange(total[-1])
        return self.ids[where], np.bincount(row, size, rows).astype(np.int64)


_encoders: dict[int, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """One per Python worker."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def pack(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """Levels of (bytes, bitmap of those that go on, rank directory)."""
    levels = []
    rest = ids.astype(np.uint32)
    while len(rest) or not levels:
        on = rest >= 256
        bits = np.packbits(on, bitorder="little")
        pad = np.zeros(-len(on) % RANK_BITS + len(on), bool)
        pad[: len(on)] = on
        ranks = np.cumsum(pad.reshape(-1, RANK_BITS).sum(axis=1))
        ranks = np.concatenate(([0], ranks))[:-1].astype("<u4")
        levels.append(((rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = rest[on] >> np.uint32(8)
    return levels


def unpack(levels: list[tuple[bytes, bytes, bytes]]) -> np.ndarray:
    """All ids of packed levels."""
    above = None
    for data, bits, _ in reversed(levels):
        low = np.frombuffer(data, np.uint8).astype(np.uint32)
        on = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(low), bitorder="little") > 0
        if on.any():
            low[on] |= above << np.uint32(8)
        above = low
    return above


def token_at(levels: list[tuple[bytes, bytes, bytes]], position: int) -> int:
    """The id at one position, from a rank look-up per level."""
    value = 0
    for k, (data, bits, ranks) in enumerate(levels):
        value |= data[position] << (8 * k)
        if not bits[position >> 3] >> (position & 7) & 1:
            return value
        block = position // RANK_BITS
        before = int.from_bytes(ranks[4 * block : 4 * block + 4], "little")
        low = block * RANK_BITS // 8
        before += sum(b.bit_count() for b in bits[low : position >> 3])
        position = before + (bits[position >> 3] & ((1 << (position & 7)) - 1)).bit_count()
    raise ValueError("an id goes on beyond its last level")


_LEVEL = "struct<codes: binary, bits: binary, ranks: binary>"
SCHEMA = (
    "part int, shard int, before bigint, n_tokens bigint, "
    f"doc_ids array<bigint>, lengths array<bigint>, levels array<{_LEVEL}>"
)
_LEVEL_TYPE = pa.struct([(name, pa.binary()) for name in ("codes", "bits", "ranks")])


def _shard(part: int, number: int, before: int, doc_ids: list, lengths: list, ids: list):
    levels = pack(np.concatenate(ids))
    total = int(sum(map(len, ids)))
    named = [dict(zip(("codes", "bits", "ranks"), level, strict=True)) for level in levels]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()),
            pa.array([number], pa.int32()),
            pa.array([before], pa.int64()),
            pa.array([total], pa.int64()),
            pa.array([doc_ids], pa.list_(pa.int64())),
            pa.array([lengths], pa.list_(pa.int64())),
            pa.array([named], pa.list_(_LEVEL_TYPE)),
        ],
        names=["part", "shard", "before", "n_tokens", "doc_ids", "lengths", "levels"],
    )


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer_json: str,
    end_id: int,
    text: str = "text",
    key: str = "doc_id",
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encodes every text, closes it with ``end_id`` and writes the store to ``path``."""
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary, a fixed input

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(held.value)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, ids, size = [], [], [], 0
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                found, n = tool.encode(*flat(batch.column(1).slice(lo, hi - lo)))
                found = np.insert(found, np.cumsum(n), np.uint32(end_id))
                doc_ids += batch.column(0).slice(lo, hi - lo).to_pylist()
                lengths += (n + 1).tolist()
                ids.append(found)
                size += len(found)
                if size >= shard_tokens:
                    yield _shard(part, number, before, doc_ids, lengths, ids)
                    number, before = number + 1, before + size
                    doc_ids, lengths, ids, size = [], [], [], 0
        if doc_ids:
            yield _shard(part, number, before, doc_ids, lengths, ids)

    rows = docs.select(
        F.col(key).cast("bigint").alias("key"),
        F.col(text).alias("text"),
        F.xxhash64(F.col(text)).alias("tie"),
    )
    (
        rows.repartitionByRange("key", "tie")
        .sortWithinPartitions("key", "tie")
        .select("key", "text")
        .mapInArrow(encode, SCHEMA)
        .write.parquet(path)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The shards, with ``start``: the tokens of the whole store before each."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row of two numbers per write task
    offsets = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    return (
        shards.join(F.broadcast(offsets), "part")
        .withColumn("start", F.col("offset") + F.col("before"))
        .drop("offset")
    )


def _levels(column: pa.Array, k: int) -> list[tuple[bytes, bytes, bytes]]:
    return [(x["codes"], x["bits"], x["ranks"]) for x in column[k].as_py()]


def documents_of(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (of little-endian 32-bit ids) of every
    document, read back from the codes; with ``with_ids`` also ``ids``."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    schema += ", ids array<bigint>" if with_ids else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lengths = np.array(batch.column(2)[k].as_py(), np.int64)
                ids = unpack(_levels(batch.column(3), k))
                stop = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [
                    zlib.crc32(raw[4 * a : 4 * b])
                    for a, b in zip((stop - lengths).tolist(), stop.tolist(), strict=True)
                ]
                start = batch.column(0)[k].as_py() + stop - lengths
                columns = [
                    pa.array(batch.column(1)[k].as_py(), pa.int64()),
                    pa.array(start),
                    pa.array(lengths),
                    pa.array(sums, pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    edges = pa.array(np.concatenate(([0], stop)), pa.int32())
                    columns.append(pa.ListArray.from_arrays(edges, pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return shards.select("start", "doc_ids", "lengths", "levels").mapInArrow(read, schema)


def tokens_at(shards: DataFrame, positions: DataFrame, position: str = "position") -> DataFrame:
    """``position`` and ``token`` for every distinct ``position`` that lies in the store.

    Positions are gathered per shard, at most as many as it has tokens, and meet its row once; only
    the bytes a rank look-up touches are read from its codes.
    """
    wanted = positions.select(F.col(position).cast("bigint").alias("position")).distinct()
    # a shard is found by the blocks of positions that it touches: an equal key, a hash join
    block = SHARD_TOKENS
    last = F.col("start") + F.col("n_tokens") - 1
    blocks = F.sequence(F.floor(F.col("start") / block), F.floor(last / block))
    spans = shards.where("n_tokens > 0").select("part", "shard", "start", "n_tokens", F.explode(blocks).alias("block"))
    inside = (F.col("position") >= F.col("start")) & (F.col("position") <= last)
    hits = (
        wanted.withColumn("block", F.floor(F.col("position") / block))
        .join(spans, "block")
        .where(inside)
        .groupBy("part", "shard")
        .agg(F.collect_list("position").alias("positions"))
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                levels, start = _levels(batch.column(0), k), batch.column(1)[k].as_py()
                asked = batch.column(2)[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked), pa.array([token_at(levels, p - start) for p in asked])],
                    names=["position", "token"],
                )

    found = shards.join(hits, ["part", "shard"]).select("levels", "start", "positions")
    return found.mapInArrow(look_up, "position bigint, token bigint")
