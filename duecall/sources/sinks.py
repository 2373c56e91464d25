"""Writers. All of them write from the executors; nothing is brought to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecall.vocabulary import GOLD_SUFFIX

_FORMATS = ("csv", "json")


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Predictions as CSV (nested values as JSON text) or as one JSON record per line.

    CSV keeps blanks and line ends of a text as they are, but an empty text reads back as null;
    use JSON where the two must stay apart.

    The format is checked before any work is started.
    """
    if fmt not in _FORMATS:
        raise ValueError(f"unsupported output format: {fmt}; use one of {_FORMATS}")
    if fmt == "json":
        df.write.option("ignoreNullFields", False).json(path)
        return
    nested = (T.StructType, T.MapType, T.ArrayType, T.VariantType)
    flat = [
        F.to_json(field.name, {"ignoreNullFields": "false"}).alias(field.name)
        if isinstance(field.dataType, nested)
        else F.col(f"`{field.name}`")
        for field in df.schema
    ]
    writer = df.select(*flat).write.option("header", True).option("escape", '"')
    for side in ("Leading", "Trailing"):
        writer = writer.option(f"ignore{side}WhiteSpace", False)
    writer.csv(path)


def write_eval_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.option("ignoreNullFields", False).json(path)


def write_gold(gold: DataFrame, path: str) -> None:
    """One folder per language. Rebalancing merges small pieces and splits a dominant language."""
    gold.hint("rebalance", "language").write.partitionBy("language").option(
        "ignoreNullFields", False
    ).json(path)


def _as_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of JSON arrays, one array for each run of rows that go to the same ``name``."""
    name, held = None, None
    for batch in batches:
        names, lines = [], []

        def say(text: str) -> None:
            names.append(name)  # noqa: B023  filled and emptied batch by batch
            lines.append(text)  # noqa: B023

        for own, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held is None or own != name:
                if held is not None:
                    say(held)
                    say("]")
                name = own
                say("[")
            else:
                say(f"{held},")
            held = record
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.string())], names=["name", "value"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name, name]), pa.array([held, "]"])], names=["name", "value"])


def _record(df: DataFrame) -> Column:
    columns = [F.col(f"`{c}`") for c in df.columns]
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_json_arrays(df: DataFrame, path: str) -> None:
    """A folder of files that are one JSON array each, a record per line."""
    rows = df.select(F.lit("").alias("name"), _record(df).alias("value"))
    rows.mapInArrow(_as_arrays, "name string, value string").select("value").write.text(path)


def write_gold_arrays(gold: DataFrame, path: str) -> None:
    """Gold records as ``read_gold`` finds them: a folder ``name=<language>_test.json`` for each
    language, with files that are one JSON array each."""
    name = F.concat("language", F.lit(GOLD_SUFFIX))
    rows = gold.select(name.alias("name"), _record(gold.drop("language")).alias("value"))
    arrays = (
        rows.hint("rebalance", "name")
        .sortWithinPartitions("name")
        .mapInArrow(_as_arrays, "name string, value string")
    )
    arrays.write.partitionBy("name").text(path)
