"""Row types of requests, responses, gold records, evaluation pairs and logs."""

from __future__ import annotations

PTP_DETAILS = "STRUCT<amount: STRING, date: STRING>"

RESPONSE = (
    "disposition STRING, payment_disposition STRING, reason_for_not_paying STRING, "
    f"ptp_details {PTP_DETAILS}, remarks STRING, confidence_score DOUBLE"
)

GOLD = (
    "id STRING, transcript STRING, expected_disposition STRING, "
    "expected_payment_disposition STRING, expected_reason_for_not_paying STRING, "
    "expected_amount STRING, expected_date STRING, expected_remarks STRING"
)

LABELLED_PAIR = "input STRING, output STRING"
LABELLED_OUTPUT = (
    "disposition STRING, payment_disposition STRING, ptp_amount STRING, ptp_date STRING, "
    "remarks STRING"
)

GPU_SAMPLE = "gpu STRING, util DOUBLE, mem_total DOUBLE, mem_used DOUBLE"
