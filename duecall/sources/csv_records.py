"""Records of large CSV files whose fields may hold line breaks, read by many tasks.

Spark's text reader cuts the file at line ends into byte ranges. Whether a line begins inside a
quoted field depends on all lines before it, so every range first tells, for either case, how it
ends; put one after another, those tell how each range really begins. Then every range cuts out its
records, and those that cross ranges are put together (``json_records``).

A field is quoted if it begins with a quote; a doubled quote in it is one quote. Quotes elsewhere
are plain characters. A field that nothing closes fails the job.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.session import written
from duecall.sources.json_records import PARTS, put_together, ranges, record_batches

_IN_QUOTES = r'[^"]*+(?:""[^"]*+)*+"[^,]*+'
_FIELD = rf'(?:"{_IN_QUOTES}|[^",][^,]*+)?+'
# lines at whose end no quoted field is open, by whether one is at their beginning
_ENDS = {
    False: re.compile(rf"{_FIELD}(?:,{_FIELD})*+", re.DOTALL),
    True: re.compile(rf"{_IN_QUOTES}(?:,{_FIELD})*+", re.DOTALL),
}


def _inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line."""
    if '"' not in line:
        return inside
    return _ENDS[inside].fullmatch(line) is None


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per byte range, whether it ends inside if it begins outside, and if it begins inside."""
    own, after = None, [False, True]

    def row() -> pa.RecordBatch:
        values = (own[0], own[1], *after)
        return pa.RecordBatch.from_arrays(
            [pa.array([v]) for v in values], names=["file", "block", "outside", "within"]
        )

    for key, batch in ranges(batches):
        if key != own:
            if own is not None:
                yield row()
            own, after = key, [False, True]
        for line in batch.column("value").to_pylist():
            if '"' in line:
                after = [_inside_after(line, state) for state in after]
    if own is not None:
        yield row()


def _in_turn(table: pa.Table) -> pa.Table:
    """How the ranges of one file begin."""
    table = table.sort_by("block")
    inside, begins = False, []
    for outside, within in zip(table["outside"].to_pylist(), table["within"].to_pylist(), strict=True):
        begins.append(inside)
        inside = within if inside else outside
    return pa.table({"_file": table["file"], "_block": table["block"], "begins": pa.array(begins)})


def _cut_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, place, inside = None, 0, False
    open_: list[str] | None = None
    headless = False

    def rest() -> list[tuple[str, bytes]]:
        if open_ is None:
            return []
        return [("middle" if headless else "tail", ("\n".join(open_) + "\n").encode())]

    for key, batch in ranges(batches):
        if key != own:
            yield from record_batches(own, place, rest())
            own, place = key, 0
            inside = batch.column("begins")[0].as_py()
            open_, headless = ([], True) if inside else (None, False)
        found = []
        for line in batch.column("value").to_pylist():
            inside = _inside_after(line, inside)
            if open_ is not None:
                open_.append(line)
                if not inside:
                    found.append(("head" if headless else "record", "\n".join(open_).encode()))
                    open_, headless = None, False
            elif inside:
                open_ = [line]
            else:
                found.append(("record", line.encode()))
        yield from record_batches(own, place, found)
        place += len(found)
    yield from record_batches(own, place, rest())


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``block``, ``place`` and ``value`` (the text) of every record under ``path``, the
    header of each file being its first."""
    pieces = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )
    summed = pieces.mapInArrow(_summaries, "file string, block bigint, outside boolean, within boolean")
    begins = written(
        summed.groupBy("file").applyInArrow(_in_turn, "_file string, _block bigint, begins boolean"),
        "ranges",
    )
    same = (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    # a row of some dozen bytes per byte range
    known = pieces.join(F.broadcast(begins), same).select("file", "block", "value", "begins")
    parts = written(known.mapInArrow(_cut_ranges, PARTS), "records")
    return put_together(parts, "a quoted CSV field is not closed")


def read_csv(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """The records as columns of text, named by the header; ``names`` are the names it must have.

    Files with other headers fail. Empty lines are passed over.
    """
    records = csv_records(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    first = (F.col("block") == 0) & (F.col("place") == 0)
    headers = [r["value"] for r in records.where(first).select("value").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"CSV files with different headers: {headers}")
    found = _names(headers[0]) if headers else []
    if names is not None and headers and found != names:
        raise ValueError(f"CSV header {found} instead of {names}")
    columns = names or found
    if not columns:
        return spark.createDataFrame([], "value STRING").select()
    schema = ", ".join("`{}` STRING".format(c.replace("`", "``")) for c in columns)
    options = {
        "mode": "FAILFAST", "escape": '"', "multiLine": "true",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }
    rows = records.where(~first & (F.trim("value") != ""))
    return rows.select(F.from_csv("value", schema, options).alias("row")).select("row.*")


def _names(header: str) -> list[str]:
    """Names of the header; empty and repeated ones get their number."""
    given = next(csv.reader([header]))
    lower = [name.lower() for name in given]
    return [
        f"_c{k}" if not name else f"{name}{k}" if lower.count(name.lower()) > 1 else name
        for k, name in enumerate(given)
    ]
