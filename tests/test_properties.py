"""What holds for every answer, however odd."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from duecall.operators.clean import clean_answers
from duecall.operators.parse import parse_generations
from duecall.vocabulary import CALL_LABELS, PAYMENT_LABELS, PROMISE_LABELS

scalar = (
    st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=True)
    | st.text(max_size=12) | st.sampled_from(CALL_LABELS + PAYMENT_LABELS)
    | st.from_regex(r"20[0-9]{2}-[0-9]{2}-[0-9]{2}( .*)?", fullmatch=True) | st.just("5,000")
)
value = scalar | st.lists(scalar, max_size=2) | st.dictionaries(st.text(max_size=3), scalar, max_size=2)
answer = st.fixed_dictionaries(
    {},
    optional={
        "disposition": value,
        "payment_disposition": value | st.sampled_from(PROMISE_LABELS),
        "reason_for_not_paying": value,
        "ptp_details": value | st.fixed_dictionaries({}, optional={"amount": value, "date": value}),
        "remarks": value,
        "confidence_score": value,
        "other": value,
    },
)
call = st.tuples(
    st.text(max_size=10) | st.sampled_from(["parso 5,000", "kal 12", "dekhunga"]),
    st.sampled_from(["2026-01-27", "2026-02-30", "", "9999-12-31"]),
    answer,
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(call, min_size=20, max_size=60))
def test_outcomes_are_in_range(spark, calls):
    rows = [(n, said, day, "> " + json.dumps(said_json)) for n, (said, day, said_json) in enumerate(calls)]
    df = spark.createDataFrame(rows, "n INT, transcript STRING, current_date STRING, generation STRING")
    got = clean_answers(parse_generations(df), keep_extra=True).collect()
    assert len(got) == len(rows)
    for row in got:
        if row["failed"]:
            assert row["error"] == "Remarks is not text" and row["disposition"] is None, row
            continue
        assert row["disposition"] and row["payment_disposition"] in PAYMENT_LABELS
        score = row["confidence_score"]
        assert score != score or 0.0 <= score <= 1.0
        amount, date = row["ptp_details"]
        if row["payment_disposition"] not in PROMISE_LABELS:
            assert amount is None and date is None
        falsy = ("", "0", "0.0", "-0.0", "false", "[]", "{}")
        assert amount is None or amount in falsy or amount in row["transcript"].replace(",", "")
        assert set(row["extra"]) <= {"other"}
