"""Sources, sinks, preparation, generation, whole jobs and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from duecall.operators import prepare, synth
from duecall.operators.generate import generate
from duecall.operators.parse import split_errors
from duecall.plans.evaluation import evaluate
from duecall.plans.predict import predict, predict_file
from duecall.sources import files, sinks, turns
from duecall.sources.csv_records import csv_records
from duecall.sources.json_records import json_records
from duecall.streaming import jobs

ANSWER = '{"disposition":"busy","mood":"calm"}'


def load_busy():
    return lambda prompts: [ANSWER for _ in prompts]


def load_picky():
    def answer(prompts):
        if any("bad" in prompt.rsplit("What was said:", 1)[1] for prompt in prompts):
            raise RuntimeError("cannot read this")
        return [ANSWER for _ in prompts]

    return answer


def load_short():
    return lambda prompts: []


# --- files ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "name, kind", [("a.csv", "csv"), ("B.CSV", "csv"), ("c.Json", "json"), ("d.dat", "csv"), ("e", "csv")]
)
def test_format_by_extension(name, kind):
    assert files.file_format(name) == kind


def test_spreadsheets_are_refused():
    with pytest.raises(ValueError, match="CSV"):
        files.file_format("calls.XLSX")


def test_read_csv_keeps_text(spark, tmp_path):
    path = tmp_path / "calls.csv"
    path.write_text('id,Call_Text,n\n1,"line one\nline ""two"", end",007\n2,,x\n', encoding="utf-8")
    df = files.read_transcripts(spark, str(path))
    rows = df.orderBy("id").collect()
    assert files.find_transcript_column(df) == "Call_Text"
    assert rows[0]["Call_Text"] == 'line one\nline "two", end' and rows[0]["n"] == "007"
    assert rows[1]["Call_Text"] is None


def test_read_json_keeps_text(spark, tmp_path):
    path = tmp_path / "calls.JSON"
    path.write_text(json.dumps([{"id": 1, "transcript": {"transcript": "hi"}}, {"id": 2}]))
    df = files.read_transcripts(spark, str(path))
    assert dict(df.dtypes)["id"] == "string"
    said = df.select("id", prepare.unwrap_transcript(df, "transcript").alias("t")).orderBy("id")
    assert [r["t"] for r in said.collect()] == ["hi", None]


def test_broken_file_fails_the_job(spark, tmp_path):
    path = tmp_path / "calls.json"
    path.write_text('[{"text": "a"}, {"text": ')
    with pytest.raises(Exception, match="(?i)malformed|parse|corrupt"):
        files.read_transcripts(spark, str(path), schema="text STRING").collect()


def test_no_transcript_column(spark):
    with pytest.raises(ValueError, match="transcript"):
        files.find_transcript_column(spark.createDataFrame([(1,)], "id INT"))


def test_gold_files(spark, tmp_path):
    record = {"id": "tamil_0", "transcript": "x", "expected_amount": 1500, "expected_date": None}
    (tmp_path / "tamil_test.json").write_text(json.dumps([record, record], indent=4))
    (tmp_path / "hindi_test.json").write_text(json.dumps([record]))
    (tmp_path / "notes.txt").write_text("no gold")
    gold = files.read_gold(spark, str(tmp_path))
    assert {r["language"]: r["count"] for r in gold.groupBy("language").count().collect()} == {
        "tamil": 2, "hindi": 1,
    }
    back = str(tmp_path / "written")
    sinks.write_gold(gold, back)
    again = files.read_gold(spark, back, lines=True)
    assert sorted(map(repr, again.select(*gold.columns).collect())) == sorted(map(repr, gold.collect()))


def test_labelled_pairs(spark, tmp_path):
    rows = [
        {"input": "a", "output": json.dumps({"disposition": "ANSWERED", "ptp_amount": "5000"})},
        {"input": "b", "output": "not json"},
    ]
    (tmp_path / "pairs.json").write_text(json.dumps(rows))
    got = files.read_labelled_pairs(spark, str(tmp_path / "pairs.json")).orderBy("input").collect()
    assert got[0]["labels"]["ptp_amount"] == "5000" and got[0]["labels"]["ptp_date"] is None
    assert got[1]["labels"] is None or got[1]["labels"]["disposition"] is None


def test_unknown_output_format_starts_no_work(spark, tmp_path):
    failing = spark.range(1).select(F.raise_error(F.lit("ran")).alias("x"))
    with pytest.raises(ValueError, match="unsupported output format"):
        sinks.write_predictions(failing, str(tmp_path / "out"), "xlsx")

# --- records of large JSON files -------------------------------------------------------------------


def _splits(spark, size):
    """Lets Spark cut files into ranges of ``size`` bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key in before:
        spark.conf.set(key, size)
    return before


@pytest.mark.parametrize("size, indent", [("170", 3), ("700", None), ("10000000", 3)])
def test_arrays_and_objects_give_equal_records(spark, tmp_path, size, indent):
    rng = random.Random(int(size))
    odd = ['a "quoted" } { ] [ , : text', "back\\slash\\", "", "é 日本 😀", "\n\t\r}", "x" * 150, '\\"}', "{}", "[]"]
    rows = [
        {"id": i, "text": rng.choice(odd) + str(i), "nested": {"a": [{"b": rng.choice(odd)}, []], "c": {}}}
        for i in range(14)
    ]
    want = [json.loads(json.dumps(r)) for r in rows]
    (tmp_path / "array.json").write_text("\n" + json.dumps(rows, indent=indent, ensure_ascii=False) + " \n", encoding="utf-8")
    (tmp_path / "objects.json").write_text("\n".join(json.dumps(r, indent=indent) for r in rows), encoding="utf-8")
    before = _splits(spark, size)
    try:
        for name in ("array.json", "objects.json"):
            got = json_records(spark, str(tmp_path / name))
            found = got.orderBy("file", "block", "place").collect()
            assert [json.loads(r["value"]) for r in found] == want
            tasks = spark.read.option("lineSep", "}").text(str(tmp_path / name)).rdd.getNumPartitions()
            assert tasks > 2 if len(size) < 5 else tasks == 1
            assert len({r["block"] for r in found}) > 2 or size == "10000000"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@pytest.mark.parametrize(
    "text",
    ['[{"a": 1}', '[{"a": 1}, {"a": ', '{"a": 1', '[1, {"a": 1}]', '[[{"a": 1}]]', '[{"a": 1} x]', '{"a": 1}}',
     '{"a": 1} 5', '["}", {"a": 1}]', '{"a": "b}', "nothing"],
)
def test_malformed_files_fail(spark, tmp_path, text):
    (tmp_path / "calls.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_transcripts(spark, str(tmp_path / "calls.json"), schema="a STRING").collect()


@pytest.mark.parametrize("text, want", [("", []), (" \n", []), ("[]", []), ("[ ]\n", []), ('{"a": 1}', ["1"]),
                                        ('﻿[{"a": "x"},\n{"b": 2}]', ["x", None]), ('{"a":null}{"a":[1, "}"]}', [None, '[1,"}"]'])])
def test_small_json_files(spark, tmp_path, text, want):
    (tmp_path / "calls.json").write_text(text, encoding="utf-8")
    got = files.read_transcripts(spark, str(tmp_path / "calls.json"), schema="a STRING").collect()
    assert [r["a"] for r in got] == want
    assert len(files.read_transcripts(spark, str(tmp_path / "calls.json")).columns) == len(set(want) and {"a", "b"} & {c for c in "ab" if f'"{c}"' in text})



@pytest.mark.parametrize("size", ["150", "10000000"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_with_line_breaks_is_read_by_many_tasks(spark, tmp_path, size, end):
    import csv
    import io

    rng = random.Random(int(size))
    odd = ['a "quoted", field', "two\nlines", "\n\n", "", 'ends with "', '"', "é 日本", " blank ", "1,2", "x" * 200, "a\n\"b\nc\"\n"]
    rows = [[str(i), rng.choice(odd), rng.choice(odd), '5" pipe' if i % 2 else "7'"] for i in range(25)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerows([["id", "call text", "a.b", "last"], *rows[:-1]])
    # a quote inside a field that does not begin with one is a plain character
    text = out.getvalue().replace('"5"" pipe"', '5" pipe') + end + end + '24,x,y,z'
    rows[-1] = ["24", "x", "y", "z"]
    (tmp_path / "calls.csv").write_bytes(text.encode())
    before = _splits(spark, size)
    try:
        df = files.read_transcripts(spark, str(tmp_path / "calls.csv"))
        assert df.columns == ["id", "call text", "a.b", "last"]
        got = sorted((tuple(v or "" for v in r) for r in df.collect()), key=lambda r: int(r[0]))
        assert got == [tuple(r) for r in rows]
        blocks = csv_records(spark, str(tmp_path / "calls.csv")).select("block").distinct().count()
        assert blocks > 3 if size == "150" else blocks == 1
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_csv_edges(spark, tmp_path):
    def read(text):
        path = tmp_path / f"{random.random()}.csv"
        path.write_text(text, encoding="utf-8")
        return files.read_transcripts(spark, str(path))

    assert read("").columns == [] and read("a,b\n").count() == 0
    assert read("a,,a\n1,2,3").columns == ["a0", "_c1", "a2"]
    assert [tuple(r) for r in read("\ufeffa,b\n\n1,\n").collect()] == [("1", None)]
    for broken in ('a,b\n1,"open\n2,3\n', "a,b\n1,2,3\n"):
        with pytest.raises(Exception, match="(?i)not closed|malformed"):
            read(broken).collect()


@pytest.mark.parametrize("lines", [True, False])
def test_key_order_of_whole_records(spark, tmp_path, lines):
    """A first field of 70,000 characters does not hide what follows it."""
    rows = [{"n": "y" * 70_000, "transcript": "said", "context": "c"}] * 2 + [{"conversation": 1, "n": "z"}] * 300
    text = "\n".join(map(json.dumps, rows)) if lines else json.dumps(rows)
    (tmp_path / "calls.json").write_text(text)
    df = files.read_transcripts(spark, str(tmp_path / "calls.json"), whole_files=not lines)
    assert df.columns == ["n", "transcript", "context", "conversation"]
    assert files.find_transcript_column(df) == "transcript"
    assert df.where("transcript = 'said' and length(n) = 70000").count() == 2 and df.count() == 302


def test_json_arrays_are_written_and_read(spark, tmp_path):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "tamil").otherwise("hindi").alias("language"),
        F.concat(F.lit("} \" {"), F.col("id").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("transcript"),
        *[F.lit("v").alias(f"expected_{c}") for c in ("disposition", "payment_disposition", "reason_for_not_paying", "amount", "date", "remarks")],
    )
    sinks.write_gold_arrays(df.repartition(3), str(tmp_path / "gold"))
    for file in (tmp_path / "gold").rglob("part-*"):
        assert all(r["transcript"] is None for r in json.loads(file.read_text()))
    back = files.read_gold(spark, str(tmp_path / "gold"))
    assert sorted(map(tuple, back.select(*df.columns).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    sinks.write_json_arrays(df.limit(0), str(tmp_path / "none"))
    sinks.write_json_arrays(df.coalesce(1), str(tmp_path / "some"))
    assert files.read_transcripts(spark, str(tmp_path / "none"), "json").count() == 0
    assert files.read_transcripts(spark, str(tmp_path / "some"), "json").columns == df.columns


# --- turns ----------------------------------------------------------------------------------------


def test_turns_of_long_and_short_calls(spark):
    said = [(1, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(1000)]
    said += [(2, 1, "user", "b"), (2, 0, "system", "a"), (None, 0, "customer", None)]
    df = spark.createDataFrame(said, "conv_id INT, turn INT, role STRING, text STRING").repartition(5)
    whole = {r["conv_id"]: r["transcript"] for r in turns.assemble_transcripts(df).collect()}
    names = ["Agent", "Borrower"]
    assert whole[1] == " ".join(f"{names[t % 2]}: turn {t}" for t in range(1000))
    assert whole[2] == "System: a Borrower: b" and whole[None] == "Customer: "
    first_block = len(" ".join(whole[1].split(" Agent: turn 256")[:1]))
    for limit in (10, 4000, first_block - 1, first_block, first_block + 1, 100_000):
        short = {r["conv_id"]: r["transcript"] for r in turns.assemble_for_prompt(df, limit=limit).collect()}
        for call, text in whole.items():
            want = text if len(text) <= limit else text[:limit] + "... [TRUNCATED]"
            assert short[call] == want


def test_crowded_turn_number_is_split(spark):
    """10^5 turns of one call under one number, and null numbers: no part holds much of them."""
    n = 100_000
    crowd = spark.range(n).select(
        F.when(F.col("id") % 10 < 9, F.lit(1)).alias("conv_id"),
        F.when(F.col("id") % 2 == 0, F.lit(7)).alias("turn"),
        F.lit("user").alias("role"),
        F.concat(F.lit("w"), (F.col("id") % 50).cast("string")).alias("text"),
    )
    lines = turns._lines(crowd)
    placed = turns.in_whole_order(lines, "conv_id")
    share = placed.groupBy(F.shiftright("_place", 33).alias("part")).count()
    assert share.count() == 8 and share.agg(F.max("count")).first()[0] < n / 4
    said = [(None if i % 10 == 9 else 1, (1, 7) if i % 2 == 0 else (0, 0), f"Borrower: w{i % 50}") for i in range(n)]
    want = {c: " ".join(line for _, line in sorted((t, line) for k, t, line in said if k == c)) for c in (1, None)}
    got = {r["conv_id"]: r for r in turns.assemble_transcripts(crowd).collect()}
    assert {c: r["transcript"] for c, r in got.items()} == want
    assert {c: r["turns"] for c, r in got.items()} == {1: 90_000, None: 10_000}
    for limit in (5, 3000, 300_000):
        cut = {r["conv_id"]: r["transcript"] for r in turns.assemble_for_prompt(crowd, limit=limit).collect()}
        assert cut == {c: t[:limit] + "... [TRUNCATED]" if len(t) > limit else t for c, t in want.items()}


@pytest.mark.parametrize("most", [3, 300, 10_000])
def test_long_and_short_calls_agree(spark, most):
    said = [(c, t % 400, "user" if t % 3 else None, f"turn {t}") for c in (1, 2, None) for t in range(700)]
    said += [(3, None, "user", None), (3, None, "user", "x"), (3, 0, "system", "y")]
    df = spark.createDataFrame(said, "conv_id INT, turn INT, role STRING, text STRING").repartition(4)
    want = {r["conv_id"]: r for r in turns.assemble_transcripts(df).collect()}
    assert want[3]["transcript"] == "Borrower:  Borrower: x System: y"
    assert {r["conv_id"]: r for r in turns.assemble_transcripts(df, turns_per_call=most).collect()} == want
    for limit in (20, 5000):
        cut = turns.assemble_for_prompt(df, limit=limit, turns_per_call=most)
        assert {r["conv_id"]: r["transcript"] for r in cut.collect()} == {
            c: r["transcript"] if len(r["transcript"]) <= limit else r["transcript"][:limit] + "... [TRUNCATED]"
            for c, r in want.items()
        }
    assert turns.assemble_transcripts(df.limit(0)).count() == 0


# --- preparation and generation ----------------------------------------------------------------------


def test_prepare(spark):
    said = ["hello", " \t \x1c", None, "x" * 22001, "y" * 22000]
    df = spark.createDataFrame(list(enumerate(said)), "n INT, said STRING")
    rows = prepare.prepare_requests(df, "said", "2026-01-27").orderBy("n").collect()
    assert [r["request_error"] is None for r in rows] == [True, False, False, True, True]
    assert rows[0]["prompt"].endswith("The call took place on 2026-01-27.\nWhat was said:\nhello\n\nJSON object:\n")
    assert rows[1]["prompt"] is None
    assert rows[3]["transcript"] == "x" * 22000 + "... [TRUNCATED]"
    assert rows[3]["_original_transcript"] == "x" * 22001
    assert rows[4]["transcript"] == "y" * 22000


def test_generate_isolates_rows(spark):
    df = spark.createDataFrame([(i, "What was said:" + t) for i, t in enumerate(["a", "bad", "c"])], "n INT, prompt STRING")
    rows = generate(df.coalesce(1), load_picky, "picky").orderBy("n").collect()
    assert [r["generation"] for r in rows] == [ANSWER, None, ANSWER]
    assert rows[1]["generate_error"] == "cannot read this"
    short = generate(df, load_short, "short", partitions=2).collect()
    assert all("gave 0 texts" in r["generate_error"] for r in short)


def test_predict_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "hi"), (2, " "), (3, "bad"), (4, None)], "id INT, said STRING")
    cleaned = predict(df, "said", load_picky, "picky", "2026-01-27", keep=["id"], keep_extra=True)
    rows = {r["id"]: r for r in cleaned.collect()}
    assert rows[1]["disposition"] == "BUSY" and rows[1]["extra"] == {"mood": '"calm"'}
    assert rows[2]["error"] == rows[4]["error"] == "Transcript is empty"
    assert rows[3]["error"] == "cannot read this" and rows[3]["_original_transcript"] == "bad"
    fine, failed = split_errors(cleaned)
    assert fine.count() == 1 and failed.count() == 3


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(1, "hi", "2026-2-3")], ["call.id", "the.text", "call.day"])
    outcome = predict(df, "the.text", load_busy, "busy", "2026-01-27", "call.day", keep=["call.id"])
    assert outcome.first()["call.id"] == 1 and outcome.first()["disposition"] == "BUSY"


def test_kept_columns_do_not_meet_ours(spark):
    df = spark.createDataFrame([(1, "x" * 30000)], "prompt INT, transcript STRING")
    keep = ["prompt", "transcript"]
    row = predict(df, "transcript", load_busy, "busy", "2026-01-27", keep=keep).first()
    assert row["prompt"] == 1 and len(row["transcript"]) == 30000
    with pytest.raises(ValueError, match="remarks"):
        predict(df.withColumnRenamed("prompt", "remarks"), "transcript", load_busy, "busy", "2026-01-27", keep=["remarks"])


def test_predict_file_and_write(spark, tmp_path):
    (tmp_path / "up.csv").write_text("id,Conversation\n1,hello\n2,there\n")
    outcome = predict_file(spark, str(tmp_path / "up.csv"), load_busy, "busy", "2026-01-27", keep=["id"])
    for fmt in ("csv", "json"):
        out = str(tmp_path / f"out.{fmt}")
        sinks.write_predictions(outcome, out, fmt)
        back = files.read_transcripts(spark, out, whole_files=False)
        assert sorted(r["_original_transcript"] for r in back.collect()) == ["hello", "there"]


def test_plans_have_one_python_step_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "hi")], "id INT, said STRING")
    plan = predict(df, "said", load_busy, "busy", "2026-01-27", keep=["id"])
    text = plan.where("not failed")._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1
    assert "Exchange" not in text and "BatchEvalPython" not in text


def test_filters_on_outcomes_do_not_repeat_the_parsing(spark):
    from duecall.operators.clean import clean_answers
    from duecall.operators.parse import parse_generations

    df = spark.createDataFrame([("t", "2026-01-27", ANSWER)], "transcript STRING, current_date STRING, generation STRING")
    cleaned = clean_answers(parse_generations(df)).where("failed").where("disposition = 'BUSY'")
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") <= 4


def test_evaluation_run(spark):
    seeds = synth.gold_seeds(spark, ["hindi", "tamil"], 25)
    assert {r["language"]: r["count"] for r in seeds.groupBy("language").count().collect()} == {"hindi": 25, "tamil": 25}
    matched = evaluate(synth.synth_gold(seeds), load_busy, "busy", "2026-03-05")
    assert matched.count() == 50 and matched.where("exact_match").count() == 0
    assert matched.where("failed").count() == 0 and "transcript" in matched.columns


# --- synthetic gold -----------------------------------------------------------------------------------


def test_gold_is_repeatable_and_weighted(spark):
    gold = synth.synth_gold(synth.gold_seeds(spark, ["english"], 4000))
    again = synth.synth_gold(synth.gold_seeds(spark, ["english"], 4000).repartition(7))
    assert gold.exceptAll(again).count() == 0
    shares = {r["expected_payment_disposition"]: r["count"] / 4000 for r in gold.groupBy("expected_payment_disposition").count().collect()}
    want = {"PTP": 0.4, "PAID": 0.2, "None": 0.1, "DENIED_TO_PAY": 0.2, "WILL_PAY_AFTER_VISIT": 0.1}
    assert shares == pytest.approx(want, abs=0.03)
    promised = gold.where("expected_payment_disposition = 'PTP'")
    named = F.col("transcript").contains(F.col("expected_amount").cast("string")) & F.col("transcript").contains(F.col("expected_date"))
    assert promised.where(~named).count() == 0
    assert gold.where("transcript like '%{%'").count() == 0
    assert gold.select("id").distinct().count() == 4000


def test_ten_languages_have_templates_of_their_own(spark):
    assert len(synth.TEMPLATES) == 10
    texts = [t for by_kind in synth.TEMPLATES.values() for t in by_kind.values()]
    assert len(set(texts)) == len(texts) == 50
    gold = synth.synth_gold(synth.gold_seeds(spark, list(synth.TEMPLATES), 60))
    for r in gold.collect():
        kind = {"None": "WRONG_NUMBER", "DENIED_TO_PAY": "DENIED", "WILL_PAY_AFTER_VISIT": "VISIT"}
        template = synth.TEMPLATES[r["language"]][kind.get(r["expected_payment_disposition"], r["expected_payment_disposition"])]
        want = template.replace("{amount}", str(r["expected_amount"])).replace("{date}", str(r["expected_date"]))
        assert r["transcript"] == want


def test_unknown_language_falls_back(spark):
    gold = synth.synth_gold(synth.gold_seeds(spark, ["xx"], 5))
    assert gold.count() == 5 and gold.where("transcript like 'Agent: %'").count() == 5


# --- streams -------------------------------------------------------------------------------------------


def test_streams_equal_batches(spark, tmp_path):
    from duecall.operators.clean import clean_answers
    from duecall.operators.parse import parse_generations

    rows = [(i, "said", "2026-01-27", ANSWER if i % 2 else "none") for i in range(20)]
    schema = "n INT, transcript STRING, current_date STRING, generation STRING"
    source = str(tmp_path / "in.parquet")
    spark.createDataFrame(rows, schema).write.parquet(source)
    stream = jobs.stream_dispositions(jobs.read_parquet_stream(spark, source))
    out = str(tmp_path / "out")
    jobs.run_to_files(stream, out, str(tmp_path / "cp")).awaitTermination()
    got, want = spark.read.parquet(out), clean_answers(parse_generations(spark.read.parquet(source)))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_append_mode_writes_closed_windows_once(spark, tmp_path):
    source = str(tmp_path / "log.parquet")
    spark.range(0, 7200, 60).select(
        F.timestamp_seconds("id").alias("start"),
        F.lit("success").alias("status"),
        F.lit(1.5).alias("latency"),
        F.lit(False).alias("blank"),
    ).write.parquet(source)
    stream = jobs.stream_request_metrics(jobs.read_parquet_stream(spark, source), "30 minutes", "5 minutes")
    jobs.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [r["total"] for r in rows] == [30, 30, 30]
    assert all(r["mean_latency"] == 1.5 for r in rows)

def _log(spark, path, first, last):
    spark.range(first, last, 60).select(
        F.timestamp_seconds("id").alias("start"),
        F.when(F.col("id") % 300 == 0, "error").otherwise("success").alias("status"),
        (F.col("id") % 7 + 0.5).alias("latency"),
        F.lit(False).alias("blank"),
    ).coalesce(1).write.mode("append").parquet(path)


def test_upserts_survive_a_restart(spark, tmp_path):
    """A batch that was written but not committed is written again, and counts once."""
    source, out, checkpoint = (str(tmp_path / name) for name in ("log", "out", "cp"))
    keys = ["window_start", "window_end"]
    _log(spark, source, 0, 5000)

    def stream():
        return jobs.stream_request_metrics(jobs.read_parquet_stream(spark, source), "30 minutes")

    jobs.run_upserts(stream(), out, checkpoint).awaitTermination()
    _log(spark, source, 5040, 9000)
    jobs.run_upserts(stream(), out, checkpoint).awaitTermination()
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    # as if the job had died before it could commit what it has written
    for commit in [p for p in commits if int(p.name) >= 1]:
        commit.with_name(f".{commit.name}.crc").unlink(missing_ok=True)
        commit.unlink()
    jobs.run_upserts(stream(), out, checkpoint).awaitTermination()
    _log(spark, source, 9000, 12_000)
    jobs.run_upserts(stream(), out, checkpoint).awaitTermination()
    got = jobs.read_upserts(spark, out, stream().schema, keys)
    want = jobs.stream_request_metrics(spark.read.parquet(source), "30 minutes")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.agg(F.sum("total")).first()[0] == spark.read.parquet(source).count()


def test_closed_and_open_windows_are_all_windows(spark, tmp_path):
    source = str(tmp_path / "log")
    _log(spark, source, 0, 7200)
    stream = jobs.stream_request_metrics(jobs.read_parquet_stream(spark, source), "30 minutes", "5 minutes")
    jobs.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    log, closed = spark.read.parquet(source), spark.read.parquet(str(tmp_path / "out"))
    want = sorted(map(tuple, jobs.stream_request_metrics(log, "30 minutes").collect()))
    assert closed.count() == 3 and len(want) == 4
    assert sorted(map(tuple, jobs.closed_and_open(closed, log, "30 minutes").collect())) == want
    assert sorted(map(tuple, jobs.closed_and_open(closed.limit(0), log, "30 minutes").collect())) == want



def test_availability_in_batch_and_stream(spark, tmp_path):
    """Failed and missing polls, within a batch and across batches; timers fire in the stream."""
    from duecall.operators.metrics import gpu_availability

    good, bad = "{}, 10, 100, 20", "{}, [N/A], 100, 20"
    polls = [(0, 0, good), (5, 0, good), (8, 0, bad), (9, 0, bad), (12, 0, good), (60, 0, good), (60, 0, bad),
             (0, 1, bad), (30, 1, good), (45, 1, good), (61, 1, good), (3500, 1, good), (3700, 1, good),
             (2, 2, good), (7300, 1, good), (7310, 3, "3, 1"), (7312, 3, good), (7315, 1, good), (7320, 9, ""), (7320, 1, bad)]
    want = [("0", 0, True), ("0", 8, False), ("0", 12, True), ("0", 27, False),
            ("1", 0, False), ("1", 30, True), ("1", 60, False), ("1", 61, True), ("1", 76, False),
            ("1", 3500, True), ("1", 3515, False), ("1", 3700, True), ("1", 3715, False), ("1", 7300, True), ("1", 7320, False),
            ("2", 2, True), ("2", 17, False), ("3", 7310, False), ("3", 7312, True)]
    rows = [(t, line.format(gpu)) for t, gpu, line in polls]
    samples = spark.createDataFrame(rows, "t BIGINT, line STRING").select(F.timestamp_seconds(F.col("t") + 10**6).alias("ts"), "line")

    def seen(df):
        return sorted((r["gpu"], r["s"], r["available"]) for r in df.select("gpu", (F.unix_seconds("since") - 10**6).alias("s"), "available").collect())

    assert seen(gpu_availability(samples)) == sorted(want)
    assert gpu_availability(samples.limit(0)).count() == 0
    source, out, checkpoint = (str(tmp_path / name) for name in ("log", "out", "cp"))
    for lo, hi in ((0, 10), (10, 46), (46, 4000), (4000, 8000)):
        part = samples.where((F.unix_seconds("ts") - 10**6).between(lo, hi - 1)).coalesce(1)
        part.write.mode("append").parquet(source)
        stream = jobs.stream_gpu_availability(jobs.read_parquet_stream(spark, source))
        jobs.run_to_files(stream, out, checkpoint).awaitTermination()
    assert seen(spark.read.parquet(out)) == sorted(want)


def test_json_keys_keep_file_order(spark, tmp_path):
    path = tmp_path / "calls.json"
    path.write_text('[{"transcript": "said", "context": "why"}, {"context": "x", "transcript": "y"}]')
    assert files.find_transcript_column(files.read_transcripts(spark, str(path))) == "transcript"


def test_csv_folder_with_another_column_order_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n1,hello\n")
    (tmp_path / "b.csv").write_text("text,id\nworld,2\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        files.read_transcripts(spark, str(tmp_path), "csv").collect()


def test_csv_keeps_blanks(spark, tmp_path):
    said = [" (note)", "tail \n", "a\"b,c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "id INT, text STRING")
    sinks.write_predictions(df, str(tmp_path / "out"), "csv")
    back = files.read_transcripts(spark, str(tmp_path / "out"), "csv").orderBy("id")
    assert [r["text"] for r in back.collect()] == said


def test_missing_template_raises(spark):
    seeds = synth.gold_seeds(spark, ["hindi"], 5)
    with pytest.raises(ValueError, match="no template"):
        synth.synth_gold(seeds, {"hindi": {"PTP": "x"}})
    assert synth.synth_gold(seeds, {"tamil": synth.TEMPLATES["hindi"]}).count() == 5


def test_python_gets_bounded_batches(spark):
    """20 MB of text in one partition reach Python in batches of some megabytes."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from duecall import configure

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    rows = configure(spark).range(0, 4000, 1, 1).select(F.expr("repeat('x', 5000)").alias("text"))
    found = [r["size"] for r in rows.mapInArrow(sizes, "size bigint").collect()]
    assert sum(found) >= 20_000_000 and max(found) < 6_000_000
