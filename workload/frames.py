"""Inputs of the queries, derived by Spark from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall import configure
from duecall.functions.fence import fenced
from duecall.operators.clean import clean_answers
from duecall.operators.evaluate import match_fields
from duecall.operators.parse import parse_generations
from duecall.operators.synth import TEMPLATES, add_transcripts, draw, draw_scenarios, scenario_truth
from workload.cases import CASES, RUN_DATE

EVAL_DATE = "2026-03-05"
# every eleventh length gives a language without templates of its own
LANGUAGES = [*TEMPLATES, "german"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def recorded_calls(documents: DataFrame) -> DataFrame:
    """Every document as a call: what the case says, then the whole text; and its generation."""
    rows = [(i, said, day or RUN_DATE, text) for i, (said, day, text) in enumerate(CASES)]
    cases = documents.sparkSession.createDataFrame(
        rows, "case_no BIGINT, said STRING, current_date STRING, generation STRING"
    )
    return (
        documents.withColumn("case_no", F.col("doc_id") % len(CASES))
        .join(F.broadcast(cases), "case_no")  # 48 rows
        .select(
            "doc_id",
            "lang",
            F.concat_ws(" ", "said", "text").alias("transcript"),
            "current_date",
            "generation",
        )
    )


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded_calls(table(spark, sf_dir, "documents"))


def text_length(text: str = "text") -> Column:
    return F.coalesce(F.length(text), F.lit(0))


def iso_date(number: Column) -> Column:
    """A date of 2026 that may not exist, from the number."""
    month, day = F.lpad((number % 14).cast("string"), 2, "0"), F.lpad((number % 33).cast("string"), 2, "0")
    return F.concat(F.lit("2026-"), month, F.lit("-"), day)


def answered_rows(documents: DataFrame) -> DataFrame:
    """A generation made from every row's own text, source, language and length.

    Keys are there or missing, null, of one type or another; the text follows as remarks. Some
    generations are the bare text, cut short, doubled, or stand between other words.
    """
    n, lit = F.col("n"), F.lit

    def one_of(*values: Column | None) -> Column:
        chosen = F.lit(None).cast("string")
        for k, value in enumerate(values):
            if value is not None:
                chosen = F.when(n % len(values) == k, value).otherwise(chosen)
        return chosen

    def text(*parts: Column | str) -> Column:
        return F.concat(lit('"'), *[lit(x) if isinstance(x, str) else x for x in parts], lit('"'))

    def member(key: str, value: Column) -> Column:
        return F.concat(lit(f'"{key}":'), value)

    null, number = lit("null"), n.cast("string")
    source, lang, word = F.col("source"), F.col("lang"), F.col("word")
    details = F.concat_ws(
        ",",
        member("amount", one_of(number, text(number), F.concat(number, lit(".75")), text(), text("Rs ", number), None)),
        member("date", one_of(text(iso_date(n)), text(iso_date(n), "T10:00:00"), text("on ", iso_date(n)), null)),
    )
    thousandths = F.concat(F.floor(n / 1000).cast("string"), lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    members = [
        member("disposition", one_of(null, text(source), text(lang, " busy"), text(word), text("Wrong ", word), text("family of ", source), text(" answered"), text("x"), None)),
        member("payment_disposition", one_of(null, text("promise to pay"), text("claims ", word), text("refused"), text(lang), text("PTP"), None)),
        member("reason_for_not_paying", one_of(null, text("job loss of ", word), text(source), text("FUNDS_ISSUE"), None)),
        F.concat(lit('"ptp_details":{'), details, lit("}")),
        member("confidence_score", one_of(thousandths, text("high"), null, F.concat(lit("0."), F.lpad((n % 100).cast("string"), 2, "0")), None)),
        member("remarks", text(F.col("escaped"))),
    ]
    plain = F.regexp_replace("said", r"[\x00-\x1f]", " ")
    escaped = F.replace(F.replace(plain, lit("\\"), lit("\\\\")), lit('"'), lit('\\"'))
    rows = documents.select(
        "doc_id",
        F.coalesce("text", lit("")).alias("said"),
        *[F.coalesce(c, lit("")).alias(c) for c in ("lang", "source")],
        text_length().alias("n"),
    ).withColumns({"word": F.regexp_extract("said", "^[A-Za-z]+", 0), "escaped": escaped})
    written = rows.withColumn("js", F.concat(lit("{"), F.concat_ws(",", *members), lit("}")))
    generation = (
        F.when(n % 11 == 0, F.col("said"))
        .when(n % 11 == 1, F.expr("substring(js, 1, length(js) - 2)"))
        .when(n % 11 == 2, F.concat("js", lit(" "), "js"))
        .when(n % 11 == 3, F.concat("word", lit(" } "), "js"))
        .otherwise(F.concat("word", lit(": "), "js", lit(" - "), "lang"))
    )
    return written.select("doc_id", generation.alias("generation"))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered_rows(table(spark, sf_dir, "documents"))


def parsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_generations(answered(spark, sf_dir))


def parsed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_generations(recorded(spark, sf_dir))


def cleaned_cases(spark: SparkSession, sf_dir: str, keep_extra: bool = False) -> DataFrame:
    return clean_answers(parsed_cases(spark, sf_dir), keep_extra=keep_extra)


def seeds(documents: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(name) for name in LANGUAGES])
    return documents.select(
        F.element_at(names, (text_length() % len(LANGUAGES) + 1).cast("int")).alias("language"),
        F.col("doc_id").alias("seed"),
        "text",
    )


def gold_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gold record per document; its transcript is the filled template, then the whole text."""
    drawn = draw_scenarios(seeds(table(spark, sf_dir, "documents")))
    return scenario_truth(add_transcripts(drawn)).withColumn(
        "transcript", F.concat_ws(" ", "transcript", "text")
    )


def replies(gold: DataFrame) -> DataFrame:
    """Gold records with a reply to each: mostly right, sometimes loose, wrong or broken."""
    gold = gold.withColumn("noise", draw("reply", F.col("id"), "") % 20)
    noise = F.col("noise")
    usual_label = F.replace(F.lower("expected_disposition"), F.lit("_"), F.lit(" "))
    amount, date = F.col("expected_amount"), F.col("expected_date")
    null = F.lit(None)
    details = F.struct(
        F.when(noise == 9, amount + 1).when(noise == 10, null).otherwise(amount).alias("amount"),
        F.when(noise == 11, null)
        .when(noise == 12, F.concat(date, F.lit("T09:00:00")))
        .when(noise == 13, F.lit("2026-02-30"))
        .otherwise(date)
        .alias("date"),
    )
    said = F.struct(
        F.when(noise.isin(2, 3), F.lit("agent busy"))
        .when(noise == 4, F.lit("Family member"))
        .otherwise(usual_label)
        .alias("disposition"),
        F.when(noise == 5, F.lit("promise to pay"))
        .when(noise == 6, F.lit("PARTIAL_PAYMENT"))
        .when(noise == 7, null)
        .otherwise(F.col("expected_payment_disposition"))
        .alias("payment_disposition"),
        F.when(noise == 8, F.lit("job loss"))
        .otherwise(F.col("expected_reason_for_not_paying"))
        .alias("reason_for_not_paying"),
        details.alias("ptp_details"),
        F.col("text").alias("remarks"),
        ((noise - 5) / 10).alias("confidence_score"),
    )
    written = gold.withColumn("_written", F.to_json(said, {"ignoreNullFields": "false"}))
    reply = {
        "generation": F.when(noise == 0, F.lit("Sorry, no outcome."))
        .when(noise == 1, F.expr("substring(_written, 1, length(_written) - 3)"))
        .otherwise(F.concat(F.lit("Result: "), F.col("_written"), F.lit(" ."))),
        "current_date": F.lit(EVAL_DATE),
    }
    # fenced as a stored table of generations would be: apart from what made it
    return fenced(written, [name for name in gold.columns if name != "noise"], reply)


def cleaned_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_answers(parse_generations(replies(gold_calls(spark, sf_dir))))


def matched_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_fields(cleaned_replies(spark, sf_dir))


def labels_as_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality labels read as call labels."""
    label = (
        F.when(F.col("toxic") == 1, "CUSTOMER_ABUSIVE")
        .when(F.col("quality") == 1, "ANSWERED")
        .otherwise("OTHERS")
    )
    return table(spark, sf_dir, "labels").select("doc_id", label.alias("expected_disposition"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_request_log(table(spark, sf_dir, "events"))


def as_request_log(events: DataFrame) -> DataFrame:
    """Events as requests: the value is the latency; half of the errors are blank requests."""
    k = F.from_json("props", "k BIGINT")["k"]
    failed = F.col("event_type") == "error"
    return events.select(
        "event_id",
        (F.col("user_id") % 3).alias("level"),
        F.col("ts").cast("timestamp").alias("start"),
        F.col("value").alias("latency"),
        F.when(failed, "error").otherwise("success").alias("status"),
        (failed & (k % 2 == 1)).alias("blank"),
    )


def as_gpu_samples(events: DataFrame) -> DataFrame:
    """Events as lines of a GPU monitor; sign-ups give lines that are too short."""
    k = F.from_json("props", "k BIGINT")["k"]
    short = F.concat_ws(", ", F.col("user_id") % 8, k)
    whole = F.concat_ws(
        ", ", F.col("user_id") % 8, k, F.lit(15360), F.floor(F.col("value") * 10)
    )
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "signup", short).otherwise(whole).alias("line"),
    )
