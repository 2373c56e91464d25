"""Records of large JSON files, one array or many objects, read by many tasks.

A JSON array is one value, so a plain reader gives a file to one task. Here Spark's text reader cuts
the file at every ``}``, which lets it split the file into byte ranges anywhere, and two passes find
the records:

1. Every byte range tells, for either case of beginning inside or outside a string, how the depth
   changes and whether it ends inside one. Running sums over the few ranges of a file then tell how
   each of them really begins.
2. Every range, knowing its beginning, cuts out the records that lie in it. The pieces of a record
   that crosses ranges, at most two per range, are put together afterwards.

Records are the objects of a top-level array, or the objects of a file without one, over any number
of lines. Anything else at their level (numbers, texts, lists), and an object that is not closed, is
an error and fails the job. A byte order mark at the start is passed over. An empty file has no
records. Rows come with ``file``, ``block`` and ``place``, which give their order in the file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duecall.session import written

_QUOTE, _BACKSLASH, _COMMA, _OPEN, _CLOSE = (ord(c) for c in '"\\,{}')
_DEPTH = np.zeros(256, np.int64)
_DEPTH[[ord("{"), ord("[")]], _DEPTH[[ord("}"), ord("]")]] = 1, -1
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True
_MARK = b"\xef\xbb\xbf"
# text looked at together, which bounds the memory of a task
_SLICE_BYTES = 1 << 18


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The file cut at every ``}``, with the byte range that each piece begins in."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        "value",
    )


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The batches in small slices, cut where a byte range ends; rows of a range are neighbours, in
    order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy(zero_copy_only=False)
        files = batch.column("file").dictionary_encode()
        file = files.indices.to_numpy(zero_copy_only=False)
        size = pc.fill_null(pc.binary_length(batch.column("value")), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // _SLICE_BYTES
        change = (block[1:] != block[:-1]) | (file[1:] != file[:-1]) | (part[1:] != part[:-1])
        new = np.flatnonzero(change) + 1
        for lo, hi in zip([0, *new], [*new, batch.num_rows], strict=True):
            yield (files.dictionary[file[lo]].as_py(), int(block[lo])), batch.slice(lo, hi - lo)


def _bytes(batch: pa.RecordBatch) -> np.ndarray:
    """The text of a batch, with the ``}`` back behind every piece."""
    column = batch.column("value").cast(pa.large_string())
    joined = pc.binary_join(
        pa.LargeListArray.from_arrays([0, len(column)], column), pa.scalar("}", pa.large_string())
    )
    return np.frombuffer(joined[0].as_buffer().to_pybytes() + b"}", np.uint8)


def _quotes(data: np.ndarray) -> np.ndarray:
    """Places of the quotes that open or close a string: no odd run of backslashes before them."""
    at = np.flatnonzero(data == _QUOTE)
    other = np.where(data == _BACKSLASH, -1, np.arange(len(data)))
    last = np.concatenate(([-1], np.maximum.accumulate(other)))[at] if len(at) else at
    return at[(at - 1 - last) % 2 == 0]


def _inside(data: np.ndarray, quotes: np.ndarray, begins_inside: bool) -> np.ndarray:
    """Whether each byte belongs to a string, its quotes included but for the closing one."""
    turn = np.zeros(len(data), np.int8)
    turn[quotes] = 1
    return (np.cumsum(turn) + int(begins_inside)) % 2 == 1


_SUMMARY = (
    "file string, block bigint, turns bigint, outside bigint, within bigint, first bigint, "
    "length bigint, size bigint"
)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per byte range: quotes modulo 2, change of depth if it begins outside and inside a string,
    its first byte that is not blank, its number of bytes and that of the file."""
    own: tuple[str, int] | None = None
    inside, change, first, length, size = [0, 1], [0, 0], None, 0, 0

    def row() -> pa.RecordBatch:
        numbers = (own[1], inside[0], *change, first, length, size)
        return pa.RecordBatch.from_arrays(
            [pa.array([own[0]]), *(pa.array([n], pa.int64()) for n in numbers)],
            names=[c.split()[0] for c in _SUMMARY.split(", ")],
        )

    for key, batch in ranges(batches):
        if key != own:
            if own is not None:
                yield row()
            own, inside, change, first, length = key, [0, 1], [0, 0], None, 0
        data = _bytes(batch)
        length, size = length + len(data), batch.column("size")[0].as_py()
        quotes = _quotes(data)
        for k in (0, 1):
            change[k] += int(_DEPTH[data[~_inside(data, quotes, inside[k] == 1)]].sum())
            inside[k] = (inside[k] + len(quotes)) % 2
        if first is None:
            start = 3 if data[:3].tobytes() == _MARK else 0
            seen = np.flatnonzero(~_BLANK[data[start:]])
            first = int(data[start + seen[0]]) if len(seen) else None
    if own is not None:
        yield row()


def _beginnings(pieces: DataFrame) -> DataFrame:
    """How every byte range begins: ``inside`` a string or not, its ``depth``, and the ``level`` of
    the file's records (1 in an array, else 0). A row per range."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2
    first = F.first("first", ignorenulls=True).over(whole)
    known = (
        written(pieces.mapInArrow(_summaries, _SUMMARY), "ranges")
        .withColumns({"inside": inside, "level": F.when(first == ord("["), 1).otherwise(0)})
        .withColumn("change", F.when(F.col("inside") == 1, F.col("within")).otherwise(F.col("outside")))
        .withColumns(
            {
                "depth": F.coalesce(F.sum("change").over(before), F.lit(0)),
                "ends": F.sum("change").over(whole),
                # 1 if the } put behind the last piece is not in the file, 0 if it is; any other
                # number for a compressed file (a byte order mark does not count)
                "added": F.sum("length").over(whole) - F.col("size"),
            }
        )
    )
    complete = ((F.col("ends") == -1) & ~F.col("added").isin(0, -3)) | (
        (F.col("ends") == 0) & (F.col("level") == 0) & ~F.col("added").isin(1, -2)
    )
    depth = F.when(complete, F.col("depth")).otherwise(
        F.raise_error(F.concat(F.lit("malformed JSON: cut short or unbalanced: "), F.col("file")))
    )
    return known.select(
        F.struct("inside", depth.cast("bigint").alias("depth"), "level").alias("begins"),
        F.col("file").alias("_file"),
        F.col("block").alias("_block"),
    )


@dataclass
class _Cutter:
    """Cuts the records out of one byte range, batch by batch."""

    inside: bool
    depth: int
    level: int
    open: bytearray | None = None  # the record that has begun, so far
    headless: bool = False  # it began in an earlier range

    def __post_init__(self):
        if self.depth > self.level:
            self.open, self.headless = bytearray(), True

    def cut(self, data: np.ndarray) -> Iterator[tuple[str, bytes]]:
        quotes = _quotes(data)
        string = _inside(data, quotes, self.inside)
        step = np.where(string, 0, _DEPTH[data])
        depth = self.depth + np.cumsum(step)
        starts = np.flatnonzero((step == 1) & (depth == self.level + 1))
        ends = np.flatnonzero((step == -1) & (depth == self.level)) + 1
        if (data[starts] != _OPEN).any() or (data[ends - 1] != _CLOSE).any():
            raise ValueError("malformed JSON: a record is not an object")
        self._check_between(data, depth, string, starts, ends)
        text = data.tobytes()
        if self.open is not None:
            if not len(ends):
                self.open += text
                starts = starts[:0]
            else:
                yield ("head" if self.headless else "record"), bytes(self.open + text[: ends[0]])
                self.open, self.headless, ends = None, False, ends[1:]
        for at, upto in zip(starts, ends, strict=False):
            yield "record", text[at:upto]
        if len(starts) > len(ends):
            self.open = bytearray(text[starts[-1] :])
        self.inside = (int(self.inside) + len(quotes)) % 2 == 1
        self.depth = int(depth[-1]) if len(depth) else self.depth

    def _check_between(self, data, depth, string, starts, ends) -> None:
        """Between records stand blanks, commas and the brackets of the array."""
        out = (depth <= self.level) & ~_BLANK[data]
        out[ends - 1] = False
        odd = out & ((data != _COMMA) | string | (self.level == 0))
        if self.level == 1:
            odd &= ~(((data == ord("[")) & (depth == 1)) | ((data == ord("]")) & (depth == 0)))
        # behind the last piece of a file stands a } that is not in it; a mark may open the file
        odd[-1] &= data[-1] != _CLOSE
        odd &= ~np.isin(data, list(_MARK))
        if odd.any():
            raise ValueError("malformed JSON: text between records")

    def rest(self) -> Iterator[tuple[str, bytes]]:
        if self.open is not None:
            yield ("middle" if self.headless else "tail"), bytes(self.open)


PARTS = "file string, block bigint, place bigint, kind string, value binary"


def record_batches(
    own: tuple[str, int], place: int, found: list[tuple[str, bytes]]
) -> Iterator[pa.RecordBatch]:
    """Rows of ``PARTS`` for what was found in a range, from ``place`` on."""
    if found:
        n = len(found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([own[0]] * n, pa.string()),
                pa.array([own[1]] * n, pa.int64()),
                pa.array(range(place, place + n), pa.int64()),
                pa.array([kind for kind, _ in found]),
                pa.array([text for _, text in found], pa.binary()),
            ],
            names=[c.split()[0] for c in PARTS.split(", ")],
        )


def _cut_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, cutter, place = None, None, 0
    for key, batch in ranges(batches):
        if key != own:
            if cutter:
                yield from record_batches(own, place, list(cutter.rest()))
            begins = batch.column("begins")[0].as_py()
            own, place = key, 0
            cutter = _Cutter(begins["inside"] == 1, begins["depth"], begins["level"])
        found = list(cutter.cut(_bytes(batch)))
        yield from record_batches(own, place, found)
        place += len(found)
    if cutter:
        yield from record_batches(own, place, list(cutter.rest()))


def put_together(parts: DataFrame, unclosed: str) -> DataFrame:
    """Whole records from ``PARTS``: a record that crosses ranges belongs to the one it begins in."""
    text = F.col("value").cast("string")
    records = parts.where("kind = 'record'").select("file", "block", "place", text.alias("value"))
    order = Window.partitionBy("file").orderBy("block", "place")
    began = F.last(F.when(F.col("kind") == "tail", F.struct("block", "place")), ignorenulls=True)
    crossing = parts.where("kind <> 'record'").withColumn("of", began.over(order))
    piece = F.struct("block", "place", "kind", "value")
    whole = F.array_join(F.transform("pieces", lambda p: p["value"].cast("string")), "")
    joined = (
        crossing.groupBy("file", "of")
        .agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
        .select(
            "file",
            "of.block",
            "of.place",
            F.when(F.element_at("pieces", -1)["kind"] == "head", whole)
            .otherwise(F.raise_error(F.lit(unclosed)))
            .alias("value"),
        )
    )
    return records.union(joined)


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``block``, ``place`` and ``value`` (JSON text) of every record under ``path``.

    The table of byte ranges goes to every task: about a hundred bytes per range of, by default,
    128 MB. The records are written once, as their readers ask for keys and values.
    """
    pieces = _pieces(spark, path)
    begins = F.broadcast(_beginnings(pieces))
    same = (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    known = pieces.join(begins, same).select("file", "block", "value", "begins")
    parts = written(known.mapInArrow(_cut_ranges, PARTS), "records")
    return put_together(parts, "malformed JSON: the last record of a file is cut short")
