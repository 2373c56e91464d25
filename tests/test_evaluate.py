"""Matching rules, reports and follow-up on literal rows."""

import pytest
from pyspark.sql import functions as F

from duecall.operators import evaluate, follow_up, reports

PAIR = (
    "id STRING, language STRING, transcript STRING, expected_disposition STRING, "
    "expected_payment_disposition STRING, expected_reason_for_not_paying STRING, "
    "expected_amount INT, expected_date STRING, disposition STRING, payment_disposition STRING, "
    "reason_for_not_paying STRING, ptp_details STRUCT<amount: STRING, date: STRING>, "
    "remarks STRING, failed BOOLEAN"
)


def pair(number, gold, predicted, failed=False, language="hindi", said="Agent: hello"):
    disp, pay, reason, amount, date = predicted
    return (
        str(number), language, said, *gold, disp, pay, reason, (amount, date), "note", failed,
    )


FIELDS = [
    ("disposition", 0, "ANSWERED", "answered", False),
    ("disposition", 0, None, None, True),
    ("payment", 1, "PTP", "PARTIAL_PAYMENT", True),
    ("payment", 1, "None", None, False),
    ("payment", 1, "PTP", None, False),
    ("reason", 2, None, "None", True),
    ("reason", 2, "None", None, True),
    ("amount", 3, 5000, "5000", True),
    ("amount", 3, 5000, None, False),
    ("amount", 3, None, "None", True),
    ("date", 4, "2026-03-10", "2026-03-28", True),
    ("date", 4, "2026-03-10", None, False),
    ("date", 4, None, "None", True),
    ("date", 4, "2026-03-10", "None", True),
]


def test_match_rules(spark):
    rows = []
    for number, (_, place, gold, predicted, _) in enumerate(FIELDS):
        left, right = [None] * 5, [None] * 5
        left[place], right[place] = gold, predicted
        rows.append(pair(number, left, right))
    matched = evaluate.match_fields(spark.createDataFrame(rows, PAIR)).orderBy(F.col("id").cast("int"))
    for row, (measure, _, _, _, want) in zip(matched.collect(), FIELDS, strict=True):
        assert row[f"match_{measure}"] == want, (measure, row)
        assert row["exact_match"] == want


ALL = ["ANSWERED", "PTP", "FUNDS_ISSUE", 5000, "2026-03-10"]
SAID = ["ANSWERED", "PTP", "FUNDS_ISSUE", "5000", "2026-03-10"]
MISS = ["BUSY", "PTP", None, "4000", "2026-03-10"]


@pytest.fixture(scope="module")
def matched(spark):
    rows = [
        pair(0, ALL, SAID),
        pair(1, ALL, MISS, said="x" * 60),
        pair(2, ALL, [None] * 5, failed=True),
        pair(3, ALL, SAID, language="old tamil"),
    ]
    return evaluate.match_fields(spark.createDataFrame(rows, PAIR))


def test_accuracy_counts_failed_rows(matched):
    rows = {r["language"]: r for r in evaluate.accuracy(matched).collect()}
    assert rows["hindi"]["total"] == 3
    assert rows["hindi"]["disposition"] == pytest.approx(100 / 3)
    assert rows["hindi"]["payment"] == pytest.approx(200 / 3)


def test_overall_is_sorted_and_formatted(matched):
    accuracies = evaluate.accuracy(matched)
    overall = evaluate.overall_accuracy(accuracies).collect()
    assert [r["language"] for r in overall] == ["hindi", "old tamil"]
    lines = [r["line"] for r in evaluate.format_report(accuracies).collect()]
    assert lines[0] == "Hindi      |    33% |    67% |    33% |    33% |    67% |    47%"
    assert lines[1].startswith("Old tamil  |   100% |")


def test_percent_ties_go_to_even(spark):
    one = spark.createDataFrame(
        [("x", 8, 62.5, 37.5, 0.5, 1.5, 100.0)],
        "language STRING, total INT, disposition DOUBLE, payment DOUBLE, reason DOUBLE, "
        "amount DOUBLE, date DOUBLE",
    )
    line = evaluate.format_report(one).first()["line"]
    assert line == "X          |    62% |    38% |     0% |     2% |   100% |    40%"


def test_mismatches_name_the_missed_fields(matched):
    (row,) = evaluate.mismatch_report(matched, "id").collect()
    assert row["id"] == "1" and row["transcript_start"] == "x" * 50 + "..."
    assert [tuple(m) for m in row["misses"]] == [
        ("labels", "ANSWERED, PTP", "BUSY, PTP"),
        ("reason", "FUNDS_ISSUE", "None"),
        ("promise", "5000, 2026-03-10", "4000, 2026-03-10"),
    ]


def test_pairs_leave_failed_rows_out(matched):
    rows = evaluate.eval_pairs(matched, "id").orderBy("id").collect()
    assert [r["id"] for r in rows] == ["0", "1", "3"]
    assert rows[0]["gold"]["amt"] == "5000" and rows[0]["is_exact_match"]


def test_missing_prediction_is_a_failed_row(spark):
    gold = spark.createDataFrame([(1, "A"), (2, "B")], "id INT, expected_disposition STRING")
    seen = spark.createDataFrame([(1, "A", False)], "id INT, disposition STRING, failed BOOLEAN")
    rows = evaluate.align_gold(gold, seen, "id").orderBy("id").collect()
    assert [r["failed"] for r in rows] == [False, True]


LABELS = ["A"] * 5 + ["B"] * 3 + ["C"] * 2
GUESSES = ["A", "A", "A", "B", "D", "B", "A", "A", "A", "B"]


@pytest.fixture(scope="module")
def confused(spark):
    rows = [(g, p, False) for g, p in zip(LABELS, GUESSES)] + [("A", None, True)]
    df = spark.createDataFrame(rows, "gold_label STRING, guess STRING, failed BOOLEAN")
    return df, reports.confusion(df, "gold_label", "guess")


def test_classification_report_by_brute_force(confused):
    _, counts = confused
    rows = {r["label"]: r for r in reports.classification_report(counts).collect()}
    assert set(rows) == {"A", "B", "C", "D"}
    for label, row in rows.items():
        hits = sum(g == p == label for g, p in zip(LABELS, GUESSES))
        support, guessed = LABELS.count(label), GUESSES.count(label)
        precision = hits / guessed if guessed else 0
        recall = hits / support if support else 0
        f1 = 2 * precision * recall / (precision + recall) if hits else 0
        assert row["support"] == support
        assert (row["precision"], row["recall"]) == pytest.approx((precision, recall))
        assert row["f1"] == pytest.approx(f1)
    assert sum(r["support"] for r in rows.values()) == len(LABELS)


def test_averages_and_top_pairs(confused):
    df, counts = confused
    report = reports.classification_report(counts)
    row = reports.report_averages(report).first()
    labels = report.collect()
    assert row["accuracy"] == pytest.approx(0.4)
    assert row["macro_recall"] == pytest.approx(sum(r["recall"] for r in labels) / 4)
    assert row["weighted_recall"] == pytest.approx(row["accuracy"])
    top = reports.top_confusions(counts, 2).collect()
    assert [tuple(r) for r in top] == [("B", "A", 2), ("A", "B", 1)]
    strict = reports.strict_accuracy(df, "gold_label", "guess").first()
    assert strict["valid"] == 10 and strict["accuracy"] == pytest.approx(40.0)


def test_empty_inputs_give_nulls_not_errors(spark, matched):
    empty = matched.where("false")
    assert reports.ptp_kpis(empty).first()["ptp_recall"] is None
    none = spark.createDataFrame([], "parse_error STRING")
    assert reports.json_validity_rate(none).first()["validity_rate"] is None


def test_kpis(matched):
    row = reports.ptp_kpis(matched).first()
    assert row["gold_promises"] == 4
    assert row["amount_accuracy"] == 50.0 and row["ptp_recall"] == 75.0


def test_reminders_need_a_real_day(spark):
    rows = [
        ("PTP", ("5000", "2026-03-10"), False), ("PTP", (None, "2026-03-10"), False),
        ("PTP", ("0", "2026-02-00"), False), ("PAID", (None, None), False), (None, None, True),
    ]
    df = spark.createDataFrame(
        rows, "payment_disposition STRING, ptp_details STRUCT<amount: STRING, date: STRING>, failed BOOLEAN"
    )
    (row,) = follow_up.payment_reminders(follow_up.promises(df)).collect()
    assert (str(row["ptp_date"]), row["promises"], row["with_amount"]) == ("2026-03-10", 2, 1)
    assert row["amount_due"] == 5000


def test_oversampling_repeats_only_promises(spark):
    df = spark.createDataFrame([(1, "Parso dunga"), (2, "nahi"), (3, "a.b")], "id INT, text STRING")
    rows = follow_up.oversample_keywords(df, "text", ["parso", "a.b"], 3).groupBy("id").count()
    assert {r["id"]: r["count"] for r in rows.collect()} == {1: 3, 2: 1, 3: 3}
    assert follow_up.oversample_keywords(df, "text", ["a+b"], 3).count() == 3


def test_audit(spark):
    agent = spark.createDataFrame([(1, "OTHERS"), (2, "BUSY")], "call INT, agent_disposition STRING")
    cleaned = spark.createDataFrame(
        [(1, "RINGING", "None", ("1", "2"), 0.5, False), (2, None, None, None, None, True)],
        "call INT, disposition STRING, payment_disposition STRING, "
        "ptp_details STRUCT<amount: STRING, date: STRING>, confidence_score DOUBLE, failed BOOLEAN",
    )
    assert [r["call"] for r in follow_up.audit_agent_labels(agent, cleaned, "call").collect()] == [1]


def test_only_generations_of_gold_rows_are_parsed(spark):
    from duecall.plans.evaluation import align_generations

    gold = spark.createDataFrame([(1, "BUSY"), (2, "BUSY"), (2, "BUSY"), (None, "BUSY"), (9, "BUSY")], "id INT, expected_disposition STRING")
    rows = [(i, "said", "2026-01-27", '{"disposition":"busy"}' if i else "none") for i in (1, 2, 3, 4, 0, None)]
    schema = "id INT, transcript STRING, current_date STRING, generation STRING"
    aligned = align_generations(gold, spark.createDataFrame(rows, schema), "id")
    got = sorted(((r["id"] or 0, r["disposition"], r["failed"]) for r in aligned.collect()))
    assert got == [(0, None, True), (1, "BUSY", False), (2, "BUSY", False), (2, "BUSY", False), (9, None, True)]
    plan = aligned._jdf.queryExecution().optimizedPlan().toString().lower()
    # the tree is printed from the top: the key filter lies below every parsing step
    assert plan.rindex("leftsemi") > plan.rindex("parsejson")
