"""Fixed values. They decide results, so they are stated once, here, as they must be."""

# --- fixed values: call labels -------------------------------------------------------------
CALL_LABELS = [
    "ANSWERED", "ANSWERED_BY_FAMILY_MEMBER", "CUSTOMER_PICKED", "AGENT_BUSY_ON_ANOTHER_CALL",
    "SILENCE_ISSUE", "LANGUAGE_BARRIER", "ANSWERED_VOICE_ISSUE", "CUSTOMER_ABUSIVE",
    "AUTOMATED_VOICE", "FORWARDED_CALL", "RINGING", "BUSY", "SWITCHED_OFF",
    "WRONG_NUMBER", "DO_NOT_KNOW_THE_PERSON", "NOT_IN_CONTACT_ANYMORE", "OUT_OF_NETWORK",
    "OUT_OF_SERVICES", "CALL_BACK_LATER", "WILL_ASK_TO_PAY", "GAVE_ALTERNATE_NUMBER",
    "ANSWERED_DISCONNECTED", "CALL_DISCONNECTED_BY_CUSTOMER", "NOT_AVAILABLE", "WRONG_PERSON",
    "NO_INCOMING_CALLS", "RINGING_DISCONNECTED", "OTHERS",
]

# --- fixed values: payment labels ("None" is a label of its own, not null) -------------------
PAYMENT_LABELS = [
    "PAID", "PTP", "PARTIAL_PAYMENT", "SETTLEMENT", "WILL_PAY_AFTER_VISIT",
    "DENIED_TO_PAY", "NO_PAYMENT_COMMITMENT", "NO_PROOF_GIVEN", "WANT_FORECLOSURE",
    "WANTS_TO_RENEGOTIATE_LOAN_TERMS", "None",
]

# --- fixed values: labels offered to the model ----------------------------------------------
PROMPT_PAYMENT_LABELS = [
    "PTP", "PARTIAL_PAYMENT", "PAID", "DENIED_TO_PAY", "WILL_PAY_AFTER_VISIT",
    "WANTS_TO_RENEGOTIATE_LOAN_TERMS", "SETTLEMENT", "NO_PAYMENT_COMMITMENT",
    "WANT_FORECLOSURE", "None",
]
PROMPT_REASONS = [
    "FUNDS_ISSUE", "TECHNICAL_ISSUE", "JOB_CHANGED_WAITING_FOR_SALARY",
    "RATE_OF_INTEREST_ISSUES", "SALARY_NOT_CREDITED", "SERVICE_ISSUE",
    "CUSTOMER_NOT_TELLING_REASON", "OTHER_REASONS", "None",
]

# --- fixed values: promise rules -------------------------------------------------------------
PROMISE_LABELS = ["PTP", "PARTIAL_PAYMENT", "SETTLEMENT"]
VAGUE_WORDS = ["sochunga", "dekhunga"]
COMMITMENT_WORDS = [
    "pay", "paid", "amount", "rupaye", "kal", "aaj", "parso", "tarikh", "send", "karunga", "dena",
]
DOWNGRADE_NOTE = " (Policy Downgrade: Non-committal)"
DEFAULT_CONFIDENCE = 0.85

# --- fixed values: transcript limit ------------------------------------------------------------
MAX_TRANSCRIPT_CHARS = 22000
TRUNCATION_MARK = "... [TRUNCATED]"

# --- fixed values: answer fields, messages and file names ----------------------------------------
RESPONSE_FIELDS = [
    "disposition", "payment_disposition", "reason_for_not_paying", "ptp_details", "remarks",
    "confidence_score",
]
NO_JSON = "No JSON found"
EMPTY_TRANSCRIPT = "Transcript is empty"
GOLD_SUFFIX = "_test.json"

# --- fixed values: gold scenarios, their weights, amounts and days of March 2026 --------------------
SCENARIO_WEIGHTS = {"PTP": 40, "PAID": 20, "WRONG_NUMBER": 10, "DENIED": 20, "VISIT": 10}
GOLD_AMOUNTS = [1500, 2500, 4000, 5000, 10000]
GOLD_FIRST_DAY, GOLD_LAST_DAY = 10, 28
GOLD_REMARKS = "Generated sample"
# scenario: call label, payment label, reason, whether amount and date are expected
SCENARIO_TRUTH = [
    ("PTP", "ANSWERED", "PTP", "FUNDS_ISSUE", True),
    ("PAID", "ANSWERED", "PAID", "TECHNICAL_ISSUE", False),
    ("WRONG_NUMBER", "WRONG_NUMBER", "None", None, False),
    ("DENIED", "ANSWERED", "DENIED_TO_PAY", "UNEMPLOYED", False),
    ("VISIT", "ANSWERED", "WILL_PAY_AFTER_VISIT", "OTHER_REASONS", False),
]

# --- messages of our own --------------------------------------------------------------------------
BAD_JSON = "Invalid JSON"
BAD_REMARKS = "Remarks is not text"
