"""Recorded generations: what a caller said and what a model wrote, one pair per case number."""

from __future__ import annotations

HELLO = "Agent: hello"
PROMISE = "Borrower: I will give 5,000"
RUN_DATE = "2026-01-27"

_PTP = '{"payment_disposition":"PTP","ptp_details":%s}'
_AMOUNT = '{"payment_disposition":"PTP","ptp_details":{"amount":%s}}'
_DATE = '{"payment_disposition":"PTP","ptp_details":{"date":%s}}'

# (transcript, current date or None, generation)
CASES: list[tuple[str, str | None, str]] = [
    (HELLO, None, 'Sure: {"disposition":"ringing"} done'),
    (HELLO, None, "no braces here"),
    (HELLO, None, '{"disposition":"ANSWERED"'),
    (HELLO, None, "} {"),
    (HELLO, None, '{"disposition":"BUSY"} {"disposition":"RINGING"}'),
    (HELLO, None, '{"disposition":"BUSY","disposition":"RINGING"}'),
    (HELLO, None, "{'disposition':'BUSY'}"),
    (HELLO, None, '{"disposition":null}'),
    (HELLO, None, "{}"),
    (HELLO, None, '{"disposition":"AGENT BUSY"}'),
    (HELLO, None, '{"disposition":"NO ANSWER"}'),
    (HELLO, None, '{"disposition":"Customer Family"}'),
    (HELLO, None, '{"disposition":"WRONG PARTY"}'),
    (HELLO, None, '{"disposition":"dispute raised"}'),
    (HELLO, None, '{"disposition":"OK"}'),
    (HELLO, None, '{"disposition":"हिन्दी कॉल"}'),
    (HELLO, None, '{"disposition":" answered"}'),
    (HELLO, None, '{"payment_disposition":"DENIED"}'),
    (HELLO, None, '{"payment_disposition":"refused"}'),
    (HELLO, None, '{"payment_disposition":"claims done"}'),
    (HELLO, None, '{"payment_disposition":"Promise to pay"}'),
    (HELLO, None, '{"payment_disposition":null}'),
    (HELLO, None, '{"reason_for_not_paying":"job loss"}'),
    (HELLO, None, '{"reason_for_not_paying":"JOB REH GAYA"}'),
    (HELLO, None, '{"reason_for_not_paying":"free text"}'),
    (PROMISE, None, _AMOUNT % '"5,000"'),
    (PROMISE, None, _AMOUNT % "5000.75"),
    (PROMISE, None, _AMOUNT % "500"),
    (PROMISE, None, _AMOUNT % "7000"),
    (PROMISE, None, _AMOUNT % '"₹5000"'),
    (PROMISE, None, _AMOUNT % "0"),
    (PROMISE, None, _PTP % '"x"'),
    ("Borrower: parso dunga", None, _DATE % '"2026-01-27"'),
    ("Borrower: parso dunga", None, _DATE % "null"),
    ("Borrower: kal dunga", None, _DATE % '"2026-01-27"'),
    ("Borrower: kal dunga", None, _DATE % '"2026-02-01"'),
    (HELLO, None, _DATE % '"2026-02-30"'),
    (HELLO, None, _DATE % '"2026-13-01"'),
    (HELLO, None, _DATE % '"2026-02-00"'),
    (HELLO, None, _DATE % '"2026-01-29T10:00:00"'),
    (HELLO, None, _DATE % '"on 2026-01-29"'),
    (HELLO, "2026-02-30", _DATE % '"2026-01-29"'),
    (
        PROMISE,
        None,
        '{"payment_disposition":"PAID","ptp_details":{"amount":5000,"date":"2026-01-29"}}',
    ),
    ("Borrower: dekhunga", None, '{"payment_disposition":"PTP","remarks":"x"}'),
    ("Borrower: dekhunga", None, '{"payment_disposition":"PTP","remarks":null}'),
    (
        "Agent: payment? Borrower: dekhunga",
        None,
        '{"payment_disposition":"PTP","remarks":"x"}',
    ),
    (HELLO, None, '{"confidence_score":1.7}'),
    (HELLO, None, '{"confidence_score":"abc"}'),
]
