"""Cleaning rules on the recorded cases and on harder answers."""

import math

import pytest

from duecall.operators.clean import clean_answers
from duecall.operators.parse import parse_generations
from workload.cases import CASES, HELLO, PROMISE, RUN_DATE


def outcomes(spark, rows, **options):
    """rows: (transcript, current date, generation) -> cleaned rows in the same order."""
    numbered = [(i, t, RUN_DATE if d is None else d, g) for i, (t, d, g) in enumerate(rows)]
    df = spark.createDataFrame(
        numbered, "n INT, transcript STRING, current_date STRING, generation STRING"
    )
    cleaned = clean_answers(parse_generations(df), **options)
    return [row.asDict(True) for row in cleaned.orderBy("n").collect()]


ERROR = "error"
EXPECTED = {
    0: {"disposition": "RINGING", "payment_disposition": "None", "reason_for_not_paying": None,
        "confidence_score": 0.85},
    1: ERROR, 2: ERROR, 3: ERROR, 4: ERROR,
    5: {"disposition": "RINGING"},
    6: ERROR,
    7: {"disposition": "NONE"},
    8: {"disposition": "OTHERS"},
    9: {"disposition": "BUSY"},
    10: {"disposition": "ANSWERED"},
    11: {"disposition": "ANSWERED_BY_FAMILY_MEMBER"},
    12: {"disposition": "WRONG_NUMBER"},
    13: {"disposition": "DISPUTE_RAISED"},
    14: {"disposition": "OTHERS"},
    15: {"disposition": "OTHERS"},
    16: {"disposition": "ANSWERED"},
    17: {"payment_disposition": "None"},
    18: {"payment_disposition": "DENIED_TO_PAY"},
    19: {"payment_disposition": "PAID"},
    20: {"payment_disposition": "PTP"},
    21: {"payment_disposition": "None"},
    22: {"reason_for_not_paying": "JOB_CHANGED_WAITING_FOR_SALARY"},
    23: {"reason_for_not_paying": "JOB REH GAYA"},
    24: {"reason_for_not_paying": "free text"},
    25: {"amount": "5000"}, 26: {"amount": "5000"}, 27: {"amount": "500"},
    28: {"amount": None}, 29: {"amount": None}, 30: {"amount": "0"},
    31: {"amount": None, "date": None},
    32: {"date": "2026-01-29"}, 33: {"date": None}, 34: {"date": "2026-01-28"},
    35: {"date": "2026-02-01"}, 36: {"date": "2026-02-28"}, 37: {"date": None},
    38: {"date": "2026-02-00"}, 39: {"date": "2026-01-29"}, 40: {"date": None},
    41: {"date": None},
    42: {"payment_disposition": "PAID", "amount": None, "date": None},
    43: {"payment_disposition": "NO_PAYMENT_COMMITMENT",
         "remarks": "x (Policy Downgrade: Non-committal)"},
    44: ERROR,
    45: {"payment_disposition": "PTP", "remarks": "x"},
    46: {"confidence_score": 1.0},
    47: {"confidence_score": 0.85},
}


def test_recorded_cases(spark):
    assert len(CASES) == 48
    for number, row in enumerate(outcomes(spark, CASES)):
        want = EXPECTED[number]
        if want == ERROR:
            assert row["failed"] and row["error"] and row["raw"] == CASES[number][2], number
            assert row["disposition"] is None and row["ptp_details"] is None, number
            continue
        assert not row["failed"] and row["error"] is None and row["raw"] is None, number
        flat = {**row, **row["ptp_details"]}
        assert {key: flat[key] for key in want} == want, number


@pytest.mark.parametrize("tail", ['],[{"b":2}', ',{"b":2}', ' {"b":2}', '}} {"b":{"c":1}}', "]}"])
def test_trailing_data_is_an_error(spark, tail):
    (row,) = outcomes(spark, [(HELLO, None, '{"disposition":"BUSY"}' + tail)])
    if tail == "]}":
        assert row["failed"]
    assert row["error"] == "Invalid JSON"


def test_bare_number_words_are_values(spark):
    rows = outcomes(
        spark,
        [
            (HELLO, None, '{"confidence_score": NaN}'),
            (HELLO, None, '{"confidence_score":Infinity,"disposition":NaN}'),
            (HELLO, None, '{"confidence_score":-Infinity}'),
            (PROMISE, None, '{"payment_disposition":"PTP","ptp_details":{"amount":NaN}}'),
            (HELLO, None, '{"remarks":"x: NaN, y"}'),
        ],
    )
    assert math.isnan(rows[0]["confidence_score"])
    assert rows[1]["confidence_score"] == 1.0 and rows[1]["disposition"] == "NAN"
    assert rows[2]["confidence_score"] == 0.0
    assert not rows[3]["failed"] and rows[3]["ptp_details"]["amount"] is None
    assert rows[4]["remarks"] == "x: NaN, y"


def test_label_of_other_types(spark):
    answers = ["5", "123", "100.0", "true", '["ANSWERED"]', '"___"', '"ABC\\n"', "12345678901234567890"]
    rows = outcomes(spark, [(HELLO, None, '{"disposition":%s}' % a) for a in answers])
    assert [r["disposition"] for r in rows] == [
        "OTHERS", "123", "OTHERS", "TRUE", "ANSWERED", "OTHERS", "OTHERS", "12345678901234567890",
    ]


def test_amount_forms(spark):
    said = "Borrower: 5,000 or 12 or 9007199254740993 or -40, 0"
    forms = {
        '"5_000"': "5000", '" 5000 "': "5000", '"5e3"': "5000", '"५०००"': "5000", '"5000d"': None,
        "true": None, "[5000]": None, '""': "", "false": "false", "0.0": "0.0", "{}": "{}",
        '"1,2"': "12", "-40.9": "-40", "1e400": None, "0.4": "0", "9007199254740993": None,
    }
    rows = outcomes(
        spark,
        [
            (said, None, '{"payment_disposition":"PTP","ptp_details":{"amount":%s}}' % form)
            for form in forms
        ],
    )
    assert {f: r["ptp_details"]["amount"] for f, r in zip(forms, rows)} == forms


def test_date_forms(spark):
    forms = {
        '"2026-02-30 10:00"': "2026-02-28", '"२०२६-०१-०५"': "२०२६-०१-०५",
        '"२०२६-०२-३१"': "2026-02-28", '"0000-02-30"': "0000-02-29", '"2024-02-30"': "2024-02-29",
        '"2026-00-10"': None, '"Tuesday 2026-01-05"': None, '["2026-01-05"]': "2026-01-05",
        "20260105": None, '""': "", "false": "false", '"x2026-01-05y"': "2026-01-05",
    }
    rows = outcomes(
        spark,
        [
            (HELLO, None, '{"payment_disposition":"SETTLEMENT","ptp_details":{"date":%s}}' % form)
            for form in forms
        ],
    )
    assert {f: r["ptp_details"]["date"] for f, r in zip(forms, rows)} == forms


def test_reference_dates(spark):
    answer = '{"payment_disposition":"PTP","ptp_details":{"date":"2026-01-29"}}'
    references = {
        "2026-2-3": "2026-01-29", "2026-02-30": None, "x": None, "": "2026-01-29",
        "0000-01-01": None, "9999-12-30": "2026-01-29",
    }
    rows = outcomes(spark, [(HELLO, ref, answer) for ref in references])
    assert [r["ptp_details"]["date"] for r in rows] == list(references.values())
    late = outcomes(spark, [("parso", "9999-12-30", answer), ("Parso nikal", "2026-12-30", answer)])
    assert [r["ptp_details"]["date"] for r in late] == [None, "2027-01-01"]


def test_confidence_forms(spark):
    forms = {
        "true": 1.0, "false": 0.0, "null": 0.85, '"0.5"': 0.5, '" .5 "': 0.5, '"1e-1"': 0.1,
        '"-inf"': 0.0, '"Infinity"': 1.0, "[1]": 0.85, "-3": 0.0, '""': 0.85, '"0.5d"': 0.85,
    }
    rows = outcomes(spark, [(HELLO, None, '{"confidence_score":%s}' % form) for form in forms])
    assert {f: r["confidence_score"] for f, r in zip(forms, rows)} == forms


def test_policy_edges(spark):
    vague = "Borrower: sochunga"
    rows = outcomes(
        spark,
        [
            (vague, None, '{"payment_disposition":"PTP"}'),
            (vague, None, '{"payment_disposition":"PTP","remarks":5}'),
            (vague, None, '{"payment_disposition":"PTP","ptp_details":{"amount":0},"remarks":"x"}'),
            (vague, None, '{"payment_disposition":"PAID","remarks":null}'),
        ],
    )
    assert rows[0]["remarks"] == " (Policy Downgrade: Non-committal)"
    assert rows[1]["failed"]
    assert rows[2]["payment_disposition"] == "PTP"
    assert not rows[3]["failed"]


def test_model_written_error_and_extra_keys(spark):
    answer = '{"error":"no idea","disposition":"BUSY","mood":{"tone":"calm"},"n":1.50}'
    (row,) = outcomes(spark, [(HELLO, None, answer)], keep_extra=True)
    assert row["failed"] and row["error"] == "no idea" and row["disposition"] == "BUSY"
    assert row["extra"] == {"error": '"no idea"', "mood": '{"tone":"calm"}', "n": "1.5"}


def test_bare_numbers_are_mended_outside_strings_only(spark):
    answers = [
        '{"disposition": "BUSY", "confidence_score": NaN, "remarks": "score: NaN, low"}',
        '{"disposition": "BUSY", "confidence_score": -Infinity, "remarks": "Infinity"}',
        '{"disposition": "BUSY", "confidence_score": Infinity, "remarks": "a \\"b\\": NaN, \\\\"}',
    ]
    got = outcomes(spark, [(HELLO, None, answer) for answer in answers])
    assert [row["error"] for row in got] == [None] * 3
    assert [row["remarks"] for row in got] == ["score: NaN, low", "Infinity", 'a "b": NaN, \\']


def test_control_characters_are_refused_with_and_without_number_words(spark):
    """Quoted text stays as it is while bare number words are mended."""
    texts = [f'{{"confidence_score": {n}, "remarks": "a{c}b"}}' for n in ("NaN", "0.5") for c in "\x00\x01\x02\x1f\n"]
    texts += ['{"confidence_score": NaN, "remarks": "a\\u0001b"}', '{"a": NaN, "b": "open}', '{"confidence_score": NaN, "remarks": "%s"}' % ("\\\\ \\\" x" * 4000)]
    got = outcomes(spark, [(HELLO, None, text) for text in texts])
    assert [row["error"] is None for row in got] == [False] * 10 + [True, False, True]
    assert got[10]["remarks"] == "a\x01b" and len(got[12]["remarks"]) == 5 * 4000
