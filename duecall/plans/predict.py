"""From transcripts to outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.operators.clean import clean_answers
from duecall.operators.generate import GeneratorFactory, generate
from duecall.operators.parse import parse_generations
from duecall.operators.prepare import INSTRUCTION, prepare_requests, unwrap_transcript
from duecall.sources.files import find_transcript_column, read_transcripts
from duecall.vocabulary import MAX_TRANSCRIPT_CHARS

OUTCOME = [
    "disposition", "payment_disposition", "reason_for_not_paying", "ptp_details", "remarks",
    "confidence_score", "error", "raw", "failed", "truncated",
]


def predict(
    df: DataFrame,
    transcript: str,
    factory: GeneratorFactory,
    name: str,
    run_date: str,
    current_date: str | None = None,
    keep: list[str] | None = None,
    keep_extra: bool = False,
    instruction: str = INSTRUCTION,
    limit: int = MAX_TRANSCRIPT_CHARS,
    partitions: int | None = None,
) -> DataFrame:
    """Outcome of every row, with the ``keep`` columns and ``_original_transcript`` beside it.

    One narrow job: blank rows and failures stay as error rows, and only the prompt leaves the
    JVM. Transcripts are cut after ``limit`` characters, as ``truncated`` tells. A string that holds a JSON object counts as a record with a transcript in it. Filter the
    input before calling this; a filter on the result cannot save generations.
    """
    taken = sorted(set(keep or []) & {*OUTCOME, "extra", "_original_transcript"})
    if taken:
        raise ValueError(f"rename these input columns, the outcome uses the names: {taken}")
    # Carried as one value, so that input columns may have any other name.
    kept = [F.struct(*[F.col(f"`{name}`") for name in keep]).alias("kept")] if keep else []
    day = F.col(f"`{current_date}`") if current_date else F.lit(None).cast("string")
    needed = df.select(
        *kept,
        unwrap_transcript(df, transcript).alias("request_transcript"),
        day.alias("request_date"),
    )
    prepared = prepare_requests(needed, "request_transcript", run_date, "request_date", instruction, limit)
    generated = generate(prepared, factory, name, partitions=partitions)
    cleaned = clean_answers(parse_generations(generated), keep_extra=keep_extra)
    return cleaned.select(
        *(["kept.*"] if keep else []),
        *OUTCOME,
        *(["extra"] if keep_extra else []),
        "_original_transcript",
    )


def predict_file(
    spark: SparkSession,
    path: str,
    factory: GeneratorFactory,
    name: str,
    run_date: str,
    fmt: str | None = None,
    keep: list[str] | None = None,
    whole_files: bool = True,
) -> DataFrame:
    """Outcome of every row of an uploaded CSV or JSON file; keys the model adds are kept."""
    rows = read_transcripts(spark, path, fmt, whole_files=whole_files)
    return predict(
        rows,
        find_transcript_column(rows),
        factory,
        name,
        run_date,
        keep=keep,
        keep_extra=True,
    )
