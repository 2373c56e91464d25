"""The registered queries: one per operator, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.functions import labels, policy, promise
from duecall.functions.answers import slice_json
from duecall.functions.values import read_fields, whole_number_text
from duecall.operators import evaluate, follow_up, metrics, prepare, reports, synth
from duecall.operators.clean import ANSWER_PATHS
from duecall.operators.generate import generate
from duecall.plans.evaluation import align_generations
from duecall.plans.predict import predict, predict_file
from duecall.schemas import RESPONSE
from duecall.session import scratch_dir, ship
from duecall.sources import files, sinks, turns
from duecall.streaming import jobs
from workload import frames
from workload.cases import RUN_DATE
from workload.replay import load_faulty_replay, load_replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def bigint(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def rounded(*names: str) -> list[Column]:
    return [F.round(F.col(name), 6).alias(name) for name in names]


def flat(cleaned: DataFrame, *keys: str) -> DataFrame:
    """Outcome columns that a plain SQL result has too; long texts as length and hash."""
    return cleaned.select(
        *keys,
        "disposition",
        "payment_disposition",
        "reason_for_not_paying",
        F.col("ptp_details.amount").alias("amount"),
        F.col("ptp_details.date").alias("date"),
        bigint(F.length("remarks")).alias("remarks_chars"),
        F.md5("remarks").alias("remarks_md5"),
        F.round("confidence_score", 6).alias("confidence_score"),
        "error",
        "raw",
        "failed",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.table(spark, sf_dir, "documents")


# --- sources ---------------------------------------------------------------------------------


@query
def read_transcripts_csv(spark, sf_dir):
    path = scratch_dir(spark, "transcripts") + ".csv"
    written = documents(spark, sf_dir).select("doc_id", "lang", "text")
    written.write.option("header", True).option("escape", '"').csv(path)
    rows = files.read_transcripts(spark, path)
    return rows.select(
        "doc_id", "lang", bigint(F.length("text")).alias("chars"), F.md5("text").alias("text_md5")
    )


@query
def sniff_transcript_column(spark, sf_dir):
    rows = documents(spark, sf_dir)
    column = files.find_transcript_column(rows)
    return rows.select(
        "doc_id", F.lit(column).alias("transcript_column"), F.md5(F.col(column)).alias("text_md5")
    )


_GOLD_COLUMNS = [
    "language", "id", "transcript", "expected_disposition", "expected_payment_disposition",
    "expected_reason_for_not_paying", "expected_amount", "expected_date", "expected_remarks",
]


def _written_gold(spark, sf_dir) -> str:
    path = scratch_dir(spark, "gold")
    sinks.write_gold(frames.gold_calls(spark, sf_dir).select(*_GOLD_COLUMNS), path)
    return path


@query
def read_gold(spark, sf_dir):
    gold = files.read_gold(spark, _written_gold(spark, sf_dir), lines=True)
    return gold.groupBy("language").agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("id").alias("ids"),
        F.sum(bigint(F.length("transcript"))).alias("transcript_chars"),
        F.count("expected_amount").alias("with_amount"),
    )


@query
def gold_roundtrip(spark, sf_dir):
    gold = files.read_gold(spark, _written_gold(spark, sf_dir), lines=True)
    return gold.select(
        "language", "id", F.md5("transcript").alias("transcript_md5"), "expected_disposition",
        "expected_payment_disposition", "expected_reason_for_not_paying",
        bigint("expected_amount").alias("expected_amount"), "expected_date", "expected_remarks",
    )


@query
def read_gold_arrays(spark, sf_dir):
    """Gold in files named after their language, each a JSON array."""
    path = scratch_dir(spark, "gold")
    sinks.write_gold_arrays(frames.gold_calls(spark, sf_dir).select(*_GOLD_COLUMNS), path)
    return files.read_gold(spark, path).select(
        "language", "id", F.md5("transcript").alias("transcript_md5"), "expected_disposition",
        bigint("expected_amount").alias("expected_amount"), "expected_date",
    )


def _uploaded(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("text").alias("transcript"), F.col("lang").alias("context"), "doc_id"
    )


def _said(rows: DataFrame) -> DataFrame:
    said = F.col(files.find_transcript_column(rows))
    return rows.select(
        bigint("doc_id").alias("doc_id"), bigint(F.length(said)).alias("chars"), F.md5(said).alias("text_md5")
    )


@query
def read_transcripts_json(spark, sf_dir):
    """An upload of JSON arrays."""
    path = scratch_dir(spark, "upload")
    sinks.write_json_arrays(_uploaded(spark, sf_dir), path)
    return _said(files.read_transcripts(spark, path, "json"))


@query
def read_transcripts_json_lines(spark, sf_dir):
    path = scratch_dir(spark, "upload")
    _uploaded(spark, sf_dir).write.json(path)
    return _said(files.read_transcripts(spark, path, "json", whole_files=False))


def _pairs(spark, sf_dir) -> DataFrame:
    labels = F.struct(
        F.upper("source").alias("disposition"), F.col("lang").alias("payment_disposition"),
        F.col("n_chars").cast("string").alias("ptp_amount"), F.col("text").alias("remarks"),
    )
    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("input"), F.to_json(labels).alias("output")
    )


def _pair_columns(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        bigint("input").alias("doc_id"), "labels.disposition", "labels.payment_disposition",
        "labels.ptp_amount", "labels.ptp_date", F.md5("labels.remarks").alias("remarks_md5"),
    )


@query
def read_labelled_pairs(spark, sf_dir):
    path = scratch_dir(spark, "pairs")
    _pairs(spark, sf_dir).write.json(path)
    return _pair_columns(files.read_labelled_pairs(spark, path, lines=True))


@query
def read_labelled_pair_arrays(spark, sf_dir):
    path = scratch_dir(spark, "pairs")
    sinks.write_json_arrays(_pairs(spark, sf_dir), path)
    return _pair_columns(files.read_labelled_pairs(spark, path))


@query
def nested_json_column(spark, sf_dir):
    events = frames.table(spark, sf_dir, "events")
    return events.select("event_id", files.parse_json_column("props", "k BIGINT")["k"].alias("k"))


@query
def unwrap_transcript(spark, sf_dir):
    text = F.col("text")
    wrapped = documents(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(text.alias("transcript"))))
        .otherwise(text)
        .alias("said"),
    )
    said = prepare.unwrap_transcript(wrapped, "said")
    return wrapped.select("doc_id", said.alias("said")).select(
        "doc_id", bigint(F.length("said")).alias("chars"), F.md5("said").alias("text_md5")
    )


@query
def assemble_transcripts(spark, sf_dir):
    calls = turns.assemble_transcripts(frames.table(spark, sf_dir, "conversations"))
    return calls.select("conv_id", "transcript", bigint("turns").alias("turns"))


@query
def assemble_for_prompt(spark, sf_dir):
    calls = frames.table(spark, sf_dir, "conversations")
    return turns.assemble_for_prompt(calls)


# --- sinks -------------------------------------------------------------------------------------


@query
def predictions_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "predictions")
    sinks.write_predictions(frames.cleaned_cases(spark, sf_dir), path, "json")
    back = spark.read.schema(
        f"doc_id BIGINT, {RESPONSE}, error STRING, raw STRING, failed BOOLEAN"
    ).json(path)
    return flat(back, "doc_id")


@query
def predictions_csv_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "predictions") + ".csv"
    sinks.write_predictions(frames.cleaned_cases(spark, sf_dir), path, "csv")
    back = files.read_transcripts(spark, path)
    details = F.from_json("ptp_details", "amount STRING, date STRING")
    return back.select(
        bigint("doc_id").alias("doc_id"),
        "disposition",
        "payment_disposition",
        details["amount"].alias("amount"),
        details["date"].alias("date"),
        F.md5("remarks").alias("remarks_md5"),
        F.col("confidence_score").cast("double").alias("confidence_score"),
        "error",
        "raw",
        F.md5("transcript").alias("transcript_md5"),
        F.md5("generation").alias("generation_md5"),
    )


@query
def eval_pairs(spark, sf_dir):
    path = scratch_dir(spark, "pairs")
    pairs = evaluate.eval_pairs(frames.matched_replies(spark, sf_dir), "language", "id")
    sinks.write_eval_pairs(pairs, path)
    back = spark.read.schema(pairs.schema).json(path)
    sides = [
        F.col(f"{side}.{name}").alias(f"{side}_{name}")
        for side in ("gold", "predicted")
        for name in ("disp", "pay", "reason", "amt", "date")
    ]
    return back.select(
        "language", "id", F.md5("transcript").alias("transcript_md5"), *sides, "is_exact_match",
        F.md5("remarks").alias("remarks_md5"),
    )


# --- before generation -------------------------------------------------------------------------


def _blanked(spark, sf_dir) -> DataFrame:
    """Documents of which every tenth says nothing but white space, with dates from their texts."""
    number, said = F.col("doc_id"), frames.text_length()
    return documents(spark, sf_dir).select(
        "doc_id",
        F.when(number % 20 == 0, F.lit(" \t\n\u00a0\u2003"))
        .when(number % 20 == 10, F.lit(""))
        .otherwise(F.col("text"))
        .alias("transcript"),
        F.when(said % 3 == 0, F.lit(""))
        .when(said % 3 == 1, F.concat(F.lit("2026-02-"), F.lpad((said % 28 + 1).cast("string"), 2, "0")))
        .alias("current_date"),
    )


@query
def reject_blank(spark, sf_dir):
    rows = prepare.reject_blank(_blanked(spark, sf_dir))
    return rows.select("doc_id", "request_error", F.md5("transcript").alias("text_md5"))


@query
def default_current_date(spark, sf_dir):
    day = prepare.default_current_date(F.col("current_date"), RUN_DATE)
    return _blanked(spark, sf_dir).select("doc_id", day.alias("current_date"))


@query
def truncate_transcript(spark, sf_dir):
    said = prepare.truncate_transcript(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", said.alias("said")).select(
        "doc_id", bigint(F.length("said")).alias("chars"), F.md5("said").alias("text_md5")
    )


@query
def render_prompt(spark, sf_dir):
    rows = prepare.prepare_requests(_blanked(spark, sf_dir), "transcript", RUN_DATE, "current_date")
    return rows.select(
        "doc_id", bigint(F.length("prompt")).alias("chars"), F.md5("prompt").alias("prompt_md5")
    )


# --- generation ----------------------------------------------------------------------------------


def _generated(spark, sf_dir, load, name) -> DataFrame:
    ship(spark, "duecall", "workload")
    rows = prepare.prepare_requests(_blanked(spark, sf_dir), "transcript", RUN_DATE, "current_date")
    return generate(rows, load, name).select("doc_id", "generation", "generate_error")


@query
def generate_replay(spark, sf_dir):
    return _generated(spark, sf_dir, load_replay, "replay").drop("generate_error")


@query
def generate_errors(spark, sf_dir):
    return _generated(spark, sf_dir, load_faulty_replay, "faulty replay")


@query
def predict_batch(spark, sf_dir):
    ship(spark, "duecall", "workload")
    outcome = predict(
        _blanked(spark, sf_dir), "transcript", load_replay, "replay", RUN_DATE, "current_date",
        keep=["doc_id"],
    )
    return flat(outcome, "doc_id")


@query
def predict_uploaded_file(spark, sf_dir):
    ship(spark, "duecall", "workload")
    path = scratch_dir(spark, "upload") + ".csv"
    documents(spark, sf_dir).select("doc_id", "text").write.option("header", True).option(
        "escape", '"'
    ).csv(path)
    outcome = predict_file(spark, path, load_replay, "replay", RUN_DATE, keep=["doc_id"])
    return outcome.select(
        bigint("doc_id").alias("doc_id"), "disposition", "payment_disposition", "error",
        bigint(F.length("_original_transcript")).alias("original_chars"),
    )


# --- parsing -------------------------------------------------------------------------------------


@query
def slice_json_text(spark, sf_dir):
    return frames.answered(spark, sf_dir).select(
        "doc_id", slice_json(F.col("generation")).alias("slice")
    )


QUERIES["slice_json"] = QUERIES.pop("slice_json_text")


@query
def parse_json_strict(spark, sf_dir):
    field = F.try_variant_get("answer", "$.disposition", "string")
    return frames.parsed_rows(spark, sf_dir).select(
        "doc_id", "parse_error", field.alias("disposition")
    )


@query
def route_errors(spark, sf_dir):
    cleaned = frames.cleaned_cases(spark, sf_dir)
    return cleaned.groupBy("error").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("raw").alias("raw_texts")
    )


# --- labels --------------------------------------------------------------------------------------


def _fields(spark, sf_dir, *names: str):
    """Valid answers made from the rows, with the named fields read."""
    valid = frames.parsed_rows(spark, sf_dir).where(F.col("parse_error").isNull())
    return read_fields(valid, "answer", {name: ANSWER_PATHS[name] for name in names})


@query
def normalise_call_label(spark, sf_dir):
    df, fields = _fields(spark, sf_dir, "disposition")
    said = df.withColumn("said", labels.label_text(fields["disposition"], "OTHERS"))
    return said.select("doc_id", "said", labels.normalise_call_label(F.col("said")).alias("label"))


@query
def normalise_payment_label(spark, sf_dir):
    df, fields = _fields(spark, sf_dir, "payment_disposition")
    said = df.withColumn("said", labels.label_text(fields["payment_disposition"], "None"))
    return said.select(
        "doc_id", "said", labels.normalise_payment_label(F.col("said")).alias("label")
    )


@query
def map_reason(spark, sf_dir):
    df, fields = _fields(spark, sf_dir, "reason_for_not_paying")
    reason = labels.map_reason(fields["reason_for_not_paying"].text)
    return df.select("doc_id", reason.alias("reason"))


# --- promise details --------------------------------------------------------------------------------


@query
def ptp_struct_guard(spark, sf_dir):
    df, fields = _fields(spark, sf_dir, "amount", "date")
    return df.select(
        "doc_id",
        F.coalesce(fields["amount"].kind, F.lit("MISSING")).alias("amount_kind"),
        fields["amount"].text.alias("amount"),
        fields["date"].text.alias("date"),
    )


@query
def ground_amount(spark, sf_dir):
    """Amounts in many spellings against whole texts that name the document's length."""
    number = F.col("doc_id") % 6
    said = documents(spark, sf_dir).select(
        "doc_id",
        F.concat_ws(" ", "text", F.col("n_chars").cast("string"), F.lit("or 5,000")).alias("said"),
        F.when(number == 0, F.lit("5,000"))
        .when(number == 1, F.concat(F.col("n_chars").cast("string"), F.lit(".75")))
        .when(number == 2, F.lit("7000"))
        .when(number == 3, F.lit("₹5000"))
        .when(number == 4, F.lit(" 5e3 "))
        .otherwise(F.col("n_chars").cast("string"))
        .alias("amount"),
    )
    whole = said.withColumn("number", promise.amount_number(F.col("amount"))).withColumn(
        "whole", whole_number_text(F.col("number"))
    )
    return whole.select(
        "doc_id", "whole", promise.ground_amount(F.col("whole"), F.col("said")).alias("grounded")
    )


def _dated(spark, sf_dir) -> DataFrame:
    """Whole texts, some with a day word, beside dates from their lengths that may not exist."""
    number = frames.text_length()
    date = frames.iso_date(number)
    return documents(spark, sf_dir).select(
        "doc_id",
        F.concat_ws(
            " ",
            "text",
            F.when(number % 5 == 0, F.lit("Parso")).when(number % 5 == 1, F.lit("Kal")),
        ).alias("transcript"),
        date.alias("iso"),
        F.when(number % 4 == 0, date)
        .when(number % 4 == 1, F.concat(date, F.lit("T10:00:00")))
        .when(number % 4 == 2, F.concat(date, F.lit(" at noon")))
        .otherwise(F.concat(F.lit("on "), date))
        .alias("written"),
        F.when(number % 7 == 0, F.lit("2026-2-3"))
        .when(number % 7 == 1, F.lit("2026-02-30"))
        .when(number % 7 == 2, F.lit("soon"))
        .otherwise(date)
        .alias("current_date"),
    )


@query
def resolve_relative_date(spark, sf_dir):
    rows = _dated(spark, sf_dir).withColumns(
        {
            "spoken": F.lower("transcript"),
            "reference": promise.reference_date(F.col("current_date")),
        }
    )
    day = promise.resolve_relative_date(
        F.col("iso"), F.col("spoken"), F.col("reference"), F.col("current_date")
    )
    return rows.select("doc_id", day.alias("date"))


@query
def extract_iso_date(spark, sf_dir):
    day = promise.extract_iso_date(F.col("written"))
    return _dated(spark, sf_dir).select("doc_id", day.alias("date"))


@query
def cap_month_end(spark, sf_dir):
    rows = _dated(spark, sf_dir).withColumn("last", promise.month_end(F.col("iso")))
    return rows.select(
        "doc_id", "iso", promise.cap_month_end(F.col("iso"), F.col("last")).alias("date")
    )


@query
def validate_reference_date(spark, sf_dir):
    day = promise.reference_date(F.col("current_date"))
    return _dated(spark, sf_dir).select("doc_id", day.cast("string").alias("reference"))


@query
def gate_ptp(spark, sf_dir):
    cleaned = frames.cleaned_cases(spark, sf_dir)
    return cleaned.groupBy("payment_disposition").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("ptp_details.amount").alias("amounts"),
        F.count("ptp_details.date").alias("dates"),
    )


# --- policy, confidence, response ------------------------------------------------------------------


@query
def policy_downgrade(spark, sf_dir):
    cleaned = frames.cleaned_cases(spark, sf_dir)
    return cleaned.select("doc_id", "payment_disposition", "remarks", "error")


@query
def clamp_confidence(spark, sf_dir):
    df, fields = _fields(spark, sf_dir, "confidence_score")
    number = df.withColumn("number", policy.confidence_number(fields["confidence_score"]))
    return number.select("doc_id", policy.clamp_confidence(F.col("number")).alias("confidence"))


@query
def clean_output(spark, sf_dir):
    return flat(frames.cleaned_cases(spark, sf_dir), "doc_id")


@query
def clean_replies(spark, sf_dir):
    """All rules on replies that carry whole documents as remarks."""
    return flat(frames.cleaned_replies(spark, sf_dir), "language", "id").withColumn(
        "raw", F.length("raw").cast("bigint")
    )


@query
def extra_keys(spark, sf_dir):
    """Keys the response does not know, on events: every event is read as an answer."""
    from duecall.operators.clean import clean_answers
    from duecall.operators.parse import parse_generations

    events = frames.table(spark, sf_dir, "events")
    answers = events.select(
        "event_id",
        F.col("event_type").alias("transcript"),
        F.lit(RUN_DATE).alias("current_date"),
        F.col("props").alias("generation"),
    )
    cleaned = clean_answers(parse_generations(answers), keep_extra=True)
    return cleaned.select(
        "event_id",
        "disposition",
        F.array_join(F.map_keys("extra"), ",").alias("extra_keys"),
        F.element_at("extra", F.lit("k")).alias("k"),
    )


# --- evaluation ------------------------------------------------------------------------------------


def _labelled(spark, sf_dir) -> DataFrame:
    gold = frames.labels_as_gold(spark, sf_dir)
    aligned = align_generations(gold, frames.recorded(spark, sf_dir), "doc_id")
    return aligned.select(*gold.columns, "disposition", "failed")


@query
def align_gold(spark, sf_dir):
    return _labelled(spark, sf_dir).select("doc_id", "expected_disposition", "disposition", "failed")


@query
def match_fields(spark, sf_dir):
    matches = [f"match_{measure}" for measure in evaluate.MEASURES]
    return frames.matched_replies(spark, sf_dir).select("language", "id", *matches)


@query
def exact_match(spark, sf_dir):
    return frames.matched_replies(spark, sf_dir).select("language", "id", "exact_match")


@query
def accuracy_by_language(spark, sf_dir):
    result = evaluate.accuracy(frames.matched_replies(spark, sf_dir))
    return result.select("language", "total", *rounded(*evaluate.MEASURES))


@query
def overall_accuracy(spark, sf_dir):
    result = evaluate.overall_accuracy(evaluate.accuracy(frames.matched_replies(spark, sf_dir)))
    return result.select("language", *rounded("overall"))


@query
def format_report(spark, sf_dir):
    return evaluate.format_report(evaluate.accuracy(frames.matched_replies(spark, sf_dir)))


@query
def mismatch_report(spark, sf_dir):
    report = evaluate.mismatch_report(frames.matched_replies(spark, sf_dir), "language", "id")
    return report.select("language", "id", "transcript_start", F.inline("misses"))


@query
def json_validity_rate(spark, sf_dir):
    result = reports.json_validity_rate(frames.parsed_rows(spark, sf_dir))
    return result.select("total", "errors", *rounded("validity_rate"))


@query
def strict_accuracy(spark, sf_dir):
    result = reports.strict_accuracy(
        _labelled(spark, sf_dir), "expected_disposition", "disposition"
    )
    return result.select("valid", *rounded("accuracy"))


def _confused(spark, sf_dir) -> DataFrame:
    return reports.confusion(_labelled(spark, sf_dir), "expected_disposition", "disposition")


@query
def classification_report(spark, sf_dir):
    report = reports.classification_report(_confused(spark, sf_dir))
    return report.select("label", *rounded("precision", "recall", "f1"), "support")


@query
def report_averages(spark, sf_dir):
    result = reports.report_averages(reports.classification_report(_confused(spark, sf_dir)))
    return result.select(*rounded(*[c for c in result.columns if c != "support"]), "support")


@query
def top_confusions(spark, sf_dir):
    return reports.top_confusions(_confused(spark, sf_dir), 10)


@query
def ptp_kpis(spark, sf_dir):
    result = reports.ptp_kpis(frames.matched_replies(spark, sf_dir))
    return result.select(
        "gold_promises", *rounded("amount_accuracy", "date_accuracy", "ptp_recall")
    )


# --- follow-up -------------------------------------------------------------------------------------


@query
def audit_agent_labels(spark, sf_dir):
    cleaned = frames.cleaned_cases(spark, sf_dir)
    agent = documents(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("n_chars") > 1000, "ANSWERED").otherwise("OTHERS").alias("agent_disposition"),
    )
    audited = follow_up.audit_agent_labels(agent, cleaned, "doc_id")
    return audited.select("doc_id", "agent_disposition", "disposition")


@query
def payment_reminders(spark, sf_dir):
    cleaned = frames.cleaned_replies(spark, sf_dir)
    reminders = follow_up.payment_reminders(follow_up.promises(cleaned))
    return reminders.select(
        F.col("ptp_date").cast("string").alias("ptp_date"),
        "promises",
        "with_amount",
        F.col("amount_due").cast("double").alias("amount_due"),
    )


@query
def oversample_keywords(spark, sf_dir):
    rows = follow_up.oversample_keywords(documents(spark, sf_dir), "text", ["parso", "kal", "the"], 3)
    return rows.select(
        "doc_id", bigint("copy_no").alias("copy_no"), bigint(F.length("text")).alias("chars")
    )


# --- gold data -------------------------------------------------------------------------------------


@query
def synth_gold_counts(spark, sf_dir):
    gold = synth.synth_gold(frames.seeds(documents(spark, sf_dir)))
    return gold.groupBy(
        "language", "expected_disposition", "expected_payment_disposition"
    ).agg(F.count(F.lit(1)).alias("records"), F.count("expected_amount").alias("with_amount"))


@query
def fill_template(spark, sf_dir):
    drawn = synth.draw_scenarios(frames.seeds(documents(spark, sf_dir)))
    return synth.add_transcripts(drawn).select("id", "scenario", "transcript")


@query
def scenario_truth(spark, sf_dir):
    drawn = synth.draw_scenarios(frames.seeds(documents(spark, sf_dir)))
    return synth.scenario_truth(drawn).select(
        "id", "scenario", "expected_disposition", "expected_payment_disposition",
        "expected_reason_for_not_paying", bigint("expected_amount").alias("expected_amount"),
        "expected_date",
    )


# --- request metrics ---------------------------------------------------------------------------------


@query
def success_rate(spark, sf_dir):
    result = metrics.success_rate(frames.request_log(spark, sf_dir))
    return result.select("total", "successes", "errors", *rounded("success_rate", "error_rate"))


@query
def latency_stats(spark, sf_dir):
    result = metrics.latency_stats(frames.request_log(spark, sf_dir), ["level"])
    return result.select("level", "successes", *rounded("mean", "median", "min", "max"))


@query
def latency_quantiles(spark, sf_dir):
    result = metrics.latency_quantiles(frames.request_log(spark, sf_dir), ["level"])
    return result.select("level", "successes", *rounded("p90", "p95"))


@query
def load_sweep(spark, sf_dir):
    result = metrics.load_sweep(frames.request_log(spark, sf_dir))
    measures = ["success_rate", "wall_seconds", "mean", "median", "p90", "p95", "min", "max"]
    return result.select(
        "level", "total", "successes", "errors", *[F.round(m, 4).alias(m) for m in measures]
    )


@query
def request_counters(spark, sf_dir):
    return metrics.request_counters(frames.request_log(spark, sf_dir))


@query
def latency_histogram(spark, sf_dir):
    result = metrics.latency_histogram(frames.request_log(spark, sf_dir))
    return result.select("le", "cumulative", F.round("sum", 4).alias("sum"), "count")


@query
def gpu_gauges(spark, sf_dir):
    return metrics.gpu_gauges(frames.as_gpu_samples(frames.table(spark, sf_dir, "events")))


def _changes(found: DataFrame) -> DataFrame:
    since = F.date_format("since", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("since")
    return found.select("gpu", since, "available")


@query
def gpu_availability(spark, sf_dir):
    samples = frames.as_gpu_samples(frames.table(spark, sf_dir, "events"))
    return _changes(metrics.gpu_availability(samples, "10 minutes"))


@query
def throughput(spark, sf_dir):
    result = metrics.throughput(frames.request_log(spark, sf_dir), ["level"])
    return result.select(
        "level", "calls",
        *[F.round(m, 4).alias(m) for m in ("seconds", "calls_per_minute", "calls_per_hour")],
    )


# --- streams -----------------------------------------------------------------------------------------


def _stream(spark, sf_dir, name) -> DataFrame:
    frames.configure(spark)
    return jobs.read_parquet_stream(spark, f"{sf_dir}/{name}.parquet")


@query
def stream_dispositions(spark, sf_dir):
    calls = frames.recorded_calls(_stream(spark, sf_dir, "documents"))
    path, checkpoint = scratch_dir(spark, "outcomes"), scratch_dir(spark, "checkpoint")
    jobs.run_to_files(jobs.stream_dispositions(calls), path, checkpoint).awaitTermination()
    return flat(spark.read.parquet(path), "doc_id")


def _drained(stream: DataFrame, keys: list[str]) -> DataFrame:
    spark = stream.sparkSession
    path, checkpoint = scratch_dir(spark, "upserts"), scratch_dir(spark, "checkpoint")
    jobs.run_upserts(stream, path, checkpoint).awaitTermination()
    return jobs.read_upserts(spark, path, stream.schema, keys)


def _seconds(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query
def stream_request_metrics(spark, sf_dir):
    log = frames.as_request_log(_stream(spark, sf_dir, "events"))
    result = _drained(jobs.stream_request_metrics(log), ["window_start", "window_end"])
    return result.select(
        _seconds("window_start"), _seconds("window_end"), "total", "successes", "request_errors",
        *rounded("success_rate", "mean_latency", "max_latency"),
    )


@query
def stream_metrics_append(spark, sf_dir):
    """The same windows: written to files as the watermark closes them, the open ones from the log."""
    log = frames.as_request_log(_stream(spark, sf_dir, "events"))
    path, checkpoint = scratch_dir(spark, "metrics"), scratch_dir(spark, "checkpoint")
    jobs.run_to_files(jobs.stream_request_metrics(log), path, checkpoint).awaitTermination()
    closed = spark.read.parquet(path)
    windows = jobs.closed_and_open(closed, frames.request_log(spark, sf_dir))
    return windows.select(_seconds("window_start"), "total", "request_errors")


@query
def stream_latest_gauge(spark, sf_dir):
    samples = frames.as_gpu_samples(_stream(spark, sf_dir, "events"))
    return _drained(jobs.stream_latest_gauge(samples), ["gpu"])


@query
def stream_gpu_availability(spark, sf_dir):
    ship(spark, "duecall", "workload")
    samples = frames.as_gpu_samples(_stream(spark, sf_dir, "events"))
    path, checkpoint = scratch_dir(spark, "availability"), scratch_dir(spark, "checkpoint")
    jobs.run_to_files(jobs.stream_gpu_availability(samples, 600), path, checkpoint).awaitTermination()
    return _changes(spark.read.parquet(path))
