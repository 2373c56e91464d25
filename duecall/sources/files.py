"""Transcript files, gold files and labelled pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecall.schemas import GOLD, LABELLED_OUTPUT, LABELLED_PAIR
from duecall.sources.csv_records import read_csv
from duecall.sources.json_records import json_records
from duecall.vocabulary import GOLD_SUFFIX

_TRANSCRIPT_WORDS = ("transcript", "text", "conversation")


def file_format(path: str, fmt: str | None = None) -> str:
    """The given format, else the one the extension names; anything unknown is read as CSV."""
    name = path.lower().rstrip("/")
    if fmt:
        return fmt.lower()
    if name.endswith((".xls", ".xlsx")):
        raise ValueError("spreadsheets are not read; save them as CSV first")
    return "json" if name.endswith(".json") else "csv"


def read_transcripts(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: str | T.StructType | None = None,
    whole_files: bool = True,
) -> DataFrame:
    """Rows of a CSV or JSON file (or folder of files), every value as text.

    A file that cannot be read fails the job. JSON may be an array or one object after another,
    over any number of lines, and CSV fields may hold line breaks; many tasks read one file (but for
    CSV with a ``schema``: one task then). For line-based files pass ``whole_files=False``: Spark
    then splits them itself, without the passes that find where records begin. JSON without a ``schema``
    has the keys as columns in the order in which they first appear, lists and objects as JSON text.
    """
    kind = file_format(path, fmt)
    if kind == "csv" and whole_files and schema is None:
        return read_csv(spark, path)
    if kind == "csv":
        reader = spark.read.option("mode", "FAILFAST").option("multiLine", whole_files)
        # a file whose header has another order fails instead of being read by position
        reader = reader.option("header", True).option("enforceSchema", False)
        for side in ("Leading", "Trailing"):
            reader = reader.option(f"ignore{side}WhiteSpace", False)
        if schema is not None:
            reader = reader.schema(schema)
        return reader.option("escape", '"').csv(path)
    if kind == "json":
        return _parsed(json_records(spark, path) if whole_files else _json_lines(spark, path), schema)
    raise ValueError(f"unsupported input format: {kind}")


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file that has one per line, as ``json_records`` gives them."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    ).where(F.trim("value") != "")


def _parsed(records: DataFrame, schema: str | T.StructType | None) -> DataFrame:
    if schema is None:
        schema = T.StructType([T.StructField(k, T.StringType()) for k in keys_in_order(records)])
        if not schema.fields:
            return records.sparkSession.createDataFrame([], schema)
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    return records.select(row.alias("row")).select("row.*")


def keys_in_order(records: DataFrame) -> list[str]:
    """Keys of the records in the order in which they first appear, wherever that is.

    Executors look at whole records; one row per key comes to the driver.
    """
    place = F.struct("file", "block", "place", "at")
    listed = records.select("file", "block", "place", F.posexplode(F.json_object_keys("value")).alias("at", "key"))
    firsts = listed.groupBy("key").agg(F.min(place).alias("first")).collect()
    return [r["key"] for r in sorted(firsts, key=lambda r: tuple(r["first"]))]


def find_transcript_column(df: DataFrame) -> str:
    """First column, in file order, whose name speaks of a transcript, text or conversation."""
    for name in df.columns:
        if any(word in name.lower() for word in _TRANSCRIPT_WORDS):
            return name
    raise ValueError(f"no transcript/text column among {df.columns}")


def read_gold(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Gold records with their ``language``.

    A folder of ``<language>_test.json`` files (or folders of parts), each a JSON array; with
    ``lines`` the folder ``write_gold`` made, with one record per line.
    """
    if lines:
        strict = spark.read.option("mode", "FAILFAST")
        return strict.schema(f"{GOLD}, language STRING").json(path)
    suffix = GOLD_SUFFIX.replace(".", r"\.")
    records = json_records(spark, f"{path.rstrip('/')}/*.json")
    row = F.from_json("value", GOLD, {"mode": "FAILFAST"}).alias("row")
    # the part of the path that is named like a gold file
    language = F.regexp_extract("file", rf"(?:^|[/=])([^/=]+){suffix}(?:/[^/]*)?$", 1)
    return records.select(row, language.alias("language")).select("row.*", "language")


def read_labelled_pairs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``input`` text and the struct ``labels`` parsed from the JSON text in ``output``; an array,
    or with ``lines`` one pair per line."""
    pairs = read_transcripts(spark, path, "json", LABELLED_PAIR, whole_files=not lines)
    return pairs.withColumn("labels", parse_json_column("output", LABELLED_OUTPUT))


def parse_json_column(column: str, schema: str):
    """Struct of a column that holds JSON text; null where the text is not JSON."""
    return F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
