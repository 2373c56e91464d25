"""The same results in SQL, written independently of the Spark expressions."""

from __future__ import annotations

from duecall.operators.metrics import DEFAULT_BOUNDS
from duecall.operators.prepare import INSTRUCTION
from duecall.operators.synth import TEMPLATES
from duecall.vocabulary import (
    CALL_LABELS,
    COMMITMENT_WORDS,
    GOLD_AMOUNTS,
    PAYMENT_LABELS,
    SCENARIO_TRUTH,
)
from workload.cases import CASES, RUN_DATE
from workload.frames import EVAL_DATE, LANGUAGES

ORACLES: dict[str, str] = {}


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def listed(words: list[str]) -> str:
    return ", ".join(quoted(word) for word in words)


# --- common table expressions ------------------------------------------------------------------

_CASE_ROWS = ",\n".join(
    f"({i}, {quoted(said)}, {quoted(day or RUN_DATE)}, {quoted(text)})"
    for i, (said, day, text) in enumerate(CASES)
)
CASE_TABLE = f"cases(case_no, said, day, gen) AS (VALUES {_CASE_ROWS})"

RECORDED = f"""{CASE_TABLE},
calls AS (
  SELECT doc_id AS k1, '' AS k2, said || ' ' || text AS transcript, day AS today, gen AS g
  FROM documents JOIN cases ON case_no = doc_id % {len(CASES)}
)"""

LANGUAGE = f"([{listed(LANGUAGES)}])[1 + coalesce(length(text), 0) % {len(LANGUAGES)}]"


def draw(choice: str, key: str = "id") -> str:
    return f"('0x' || substr(md5('{choice}||' || {key}), 1, 8))::BIGINT"


_TEMPLATE_ROWS = ", ".join(
    f"({quoted(language)}, {quoted(kind)}, {quoted(text)})"
    for language in LANGUAGES
    for kind, text in TEMPLATES.get(language, TEMPLATES["english"]).items()
)
_TRUTH_ROWS = ", ".join(
    f"({quoted(kind)}, {quoted(d)}, {quoted(p)}, {quoted(r)}, {str(promised).lower()})"
    for kind, d, p, r, promised in SCENARIO_TRUTH
)
_AMOUNTS = ", ".join(str(amount) for amount in GOLD_AMOUNTS)
GOLD = f"""seeds AS (
  SELECT {LANGUAGE} AS language, doc_id, text, {LANGUAGE} || '_' || doc_id AS id FROM documents
),
drawn AS (
  SELECT *, CASE WHEN {draw('scenario')} % 100 < 40 THEN 'PTP' WHEN {draw('scenario')} % 100 < 60 THEN 'PAID'
      WHEN {draw('scenario')} % 100 < 70 THEN 'WRONG_NUMBER' WHEN {draw('scenario')} % 100 < 90 THEN 'DENIED'
      ELSE 'VISIT' END AS scenario,
    ([{_AMOUNTS}])[1 + {draw('amount')} % 5] AS amount,
    '2026-03-' || (10 + {draw('date')} % 19) AS date
  FROM seeds
),
templates(language, scenario, template) AS (VALUES {_TEMPLATE_ROWS}),
truth(scenario, exp_disp, exp_pay, exp_reason, promised) AS (VALUES {_TRUTH_ROWS}),
gold AS (
  SELECT language, id, scenario, text, replace(replace(template, '{{amount}}', amount::VARCHAR), '{{date}}', date) AS filled,
    exp_disp, exp_pay, exp_reason,
    CASE WHEN promised THEN amount END AS exp_amt, CASE WHEN promised THEN date END AS exp_date
  FROM drawn JOIN templates USING (language, scenario) JOIN truth USING (scenario)
)"""

REPLIES = f"""{GOLD},
noisy AS (SELECT *, {draw('reply')} % 20 AS noise FROM gold),
written AS (
  SELECT *, json_object(
    'disposition', CASE WHEN noise IN (2, 3) THEN 'agent busy' WHEN noise = 4 THEN 'Family member'
      ELSE replace(lower(exp_disp), '_', ' ') END,
    'payment_disposition', CASE noise WHEN 5 THEN 'promise to pay' WHEN 6 THEN 'PARTIAL_PAYMENT' WHEN 7 THEN NULL ELSE exp_pay END,
    'reason_for_not_paying', CASE noise WHEN 8 THEN 'job loss' ELSE exp_reason END,
    'ptp_details', json_object(
      'amount', CASE noise WHEN 9 THEN exp_amt + 1 WHEN 10 THEN NULL ELSE exp_amt END,
      'date', CASE noise WHEN 11 THEN NULL WHEN 12 THEN exp_date || 'T09:00:00' WHEN 13 THEN '2026-02-30' ELSE exp_date END),
    'remarks', text,
    'confidence_score', (noise - 5) / 10.0::DOUBLE)::VARCHAR AS js
  FROM noisy
),
calls AS (
  SELECT id AS k1, language AS k2, filled || ' ' || text AS transcript, '{EVAL_DATE}' AS today,
    CASE WHEN noise = 0 THEN 'Sorry, no outcome.' WHEN noise = 1 THEN left(js, length(js) - 3)
      ELSE 'Result: ' || js || ' .' END AS g
  FROM written
)"""

PARSED = """sliced AS (
  SELECT *, CASE WHEN strpos(g, '{') = 0 THEN NULL
    WHEN strpos(g, '}') = 0 OR length(g) - strpos(reverse(g), '}') + 1 < strpos(g, '{') THEN ''
    ELSE substr(g, strpos(g, '{'), length(g) - strpos(reverse(g), '}') + 2 - strpos(g, '{')) END AS slice
  FROM calls
),
parsed AS (
  SELECT *, CASE WHEN slice IS NULL THEN 'No JSON found' WHEN NOT json_valid(slice) THEN 'Invalid JSON' END AS parse_error,
    CASE WHEN json_valid(slice) THEN slice END AS js
  FROM sliced
),
fields AS (
  SELECT *,
    json_type(js, '$.disposition') AS disp_type,
    CASE WHEN len(regexp_extract_all(js, '"disposition":')) > 1
      THEN regexp_extract_all(js, '"disposition":"([^"]*)"', 1)[-1] ELSE js ->> '$.disposition' END AS disp_text,
    json_type(js, '$.payment_disposition') AS pay_type, js ->> '$.payment_disposition' AS pay_text,
    js ->> '$.reason_for_not_paying' AS reason_text,
    json_type(js, '$.ptp_details.amount') AS amt_type, js ->> '$.ptp_details.amount' AS amt_text,
    json_type(js, '$.ptp_details.date') AS date_type, js ->> '$.ptp_details.date' AS date_text,
    json_type(js, '$.remarks') AS rem_type, js ->> '$.remarks' AS rem_text,
    js ->> '$.confidence_score' AS conf_text
  FROM parsed
)"""


def whole(text: str) -> str:
    bare = f"trim(replace({text}, ',', ''))"
    shaped = rf"regexp_full_match({bare}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')"
    return f"CASE WHEN {shaped} THEN trunc({bare}::DOUBLE)::BIGINT::VARCHAR END"


def call_label(label: str) -> str:
    return rf"""CASE WHEN {label} IN ({listed(CALL_LABELS)}) THEN {label}
    WHEN contains({label}, 'FAMILY') THEN 'ANSWERED_BY_FAMILY_MEMBER' WHEN contains({label}, 'BUSY') THEN 'BUSY'
    WHEN contains({label}, 'WRONG') THEN 'WRONG_NUMBER' WHEN contains({label}, 'ANSWER') THEN 'ANSWERED'
    WHEN length({label}) > 2 AND regexp_full_match(replace({label}, '_', ''), '[\p{{L}}\p{{N}}]+') THEN {label}
    ELSE 'OTHERS' END"""


def pay_label(label: str) -> str:
    return f"""CASE WHEN {label} IN ({listed(PAYMENT_LABELS)}) THEN {label} WHEN contains({label}, 'CLAIM') THEN 'PAID'
    WHEN contains({label}, 'PROMISE') OR contains({label}, 'PTP') THEN 'PTP'
    WHEN contains({label}, 'REFUSE') OR contains({label}, 'DENY') THEN 'DENIED_TO_PAY' ELSE 'None' END"""


DISP_SAID = "replace(upper(CASE WHEN disp_type IS NULL THEN 'OTHERS' WHEN disp_type = 'NULL' THEN 'None' ELSE disp_text END), ' ', '_')"
PAY_SAID = "replace(upper(CASE WHEN pay_type IS NULL OR pay_type = 'NULL' THEN 'None' ELSE pay_text END), ' ', '_')"
REASON = "CASE WHEN contains(upper(reason_text), 'JOB') AND contains(upper(reason_text), 'LOSS') THEN 'JOB_CHANGED_WAITING_FOR_SALARY' ELSE reason_text END"


def reference(text: str) -> str:
    return rf"CASE WHEN regexp_full_match({text}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN TRY_CAST({text} AS DATE) END"


def relative(date: str, spoken: str, ref: str, today: str) -> str:
    return f"""CASE WHEN contains({spoken}, 'parso') THEN ({ref} + 2)::DATE::VARCHAR
      WHEN contains({spoken}, 'kal') AND {date} = {today} THEN ({ref} + 1)::DATE::VARCHAR ELSE {date} END"""


def iso(text: str) -> str:
    return rf"nullif(regexp_extract(CASE WHEN contains({text}, 'T') THEN split_part({text}, 'T', 1) ELSE split_part({text}, ' ', 1) END, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), '')"


def capped(date: str) -> str:
    last = f"last_day(TRY_CAST(left({date}, 8) || '01' AS DATE))"
    return f"CASE WHEN {last} IS NULL THEN NULL WHEN substr({date}, 9, 2)::INT > day({last}) THEN {last}::VARCHAR ELSE {date} END"


def truthy(kind: str, text: str) -> str:
    return f"coalesce(CASE WHEN {kind} = 'VARCHAR' THEN {text} <> '' WHEN {kind} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN {text}::DOUBLE <> 0 END, false)"


CONFIDENCE = r"least(greatest(coalesce(TRY_CAST(conf_text AS DOUBLE), 0.85), 0.0), 1.0)"

CLEANED = f"""labelled AS (
  SELECT *, {call_label(DISP_SAID)} AS disp, {pay_label(PAY_SAID)} AS pay, lower(transcript) AS spoken,
    {reference('today')} AS ref, {whole('amt_text')} AS amt_whole
  FROM fields
),
promised AS (
  SELECT *, pay IN ('PTP', 'PARTIAL_PAYMENT', 'SETTLEMENT') AS gate,
    CASE WHEN {truthy('amt_type', 'amt_text')}
      THEN CASE WHEN contains(replace(transcript, ',', ''), amt_whole) THEN amt_whole END ELSE amt_text END AS amt,
    {iso('(' + relative('date_text', 'spoken', 'ref', 'today') + ')')} AS iso
  FROM labelled
),
gated AS (
  SELECT *, CASE WHEN gate THEN amt END AS amount,
    CASE WHEN gate THEN CASE WHEN NOT {truthy('date_type', 'date_text')} THEN date_text
      WHEN ref IS NOT NULL THEN {capped('iso')} END END AS date
  FROM promised
),
judged AS (
  SELECT *, pay = 'PTP' AND amount IS NULL AND date IS NULL
    AND (contains(spoken, 'sochunga') OR contains(spoken, 'dekhunga'))
    AND NOT ({' OR '.join(f"contains(spoken, '{word}')" for word in COMMITMENT_WORDS)}) AS vague
  FROM gated
),
noted AS (
  SELECT *, CASE WHEN NOT vague THEN rem_text WHEN rem_type IS NULL THEN ' (Policy Downgrade: Non-committal)'
      WHEN rem_type = 'VARCHAR' THEN rem_text || ' (Policy Downgrade: Non-committal)' END AS remarks,
    coalesce(parse_error, CASE WHEN vague AND rem_type IS NOT NULL AND rem_type <> 'VARCHAR' THEN 'Remarks is not text' END) AS error
  FROM judged
),
cleaned AS (
  SELECT k1, k2, transcript, error, error IS NOT NULL AS failed,
    CASE WHEN error IS NULL THEN disp END AS disposition,
    CASE WHEN error IS NULL THEN CASE WHEN vague THEN 'NO_PAYMENT_COMMITMENT' ELSE pay END END AS payment_disposition,
    CASE WHEN error IS NULL THEN {REASON} END AS reason_for_not_paying,
    CASE WHEN error IS NULL THEN amount END AS amount, CASE WHEN error IS NULL THEN date END AS date,
    CASE WHEN error IS NULL THEN remarks END AS remarks,
    CASE WHEN error IS NULL THEN {CONFIDENCE} END AS confidence_score,
    CASE WHEN error IS NOT NULL THEN g END AS raw
  FROM noted
)"""

# generations made from the rows
ANSWERED = r"""plain AS (
  SELECT doc_id, coalesce(text, '') AS said, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(length(text), 0) AS n,
    regexp_extract(coalesce(text, ''), '^[A-Za-z]+') AS word,
    replace(replace(regexp_replace(coalesce(text, ''), '[\x00-\x1f]', ' ', 'g'), '\', '\\'), '"', '\"') AS escaped
  FROM documents
),
dates AS (SELECT *, '2026-' || lpad((n % 14)::VARCHAR, 2, '0') || '-' || lpad((n % 33)::VARCHAR, 2, '0') AS iso FROM plain),
members AS (
  SELECT *,
    '"disposition":' || CASE n % 9 WHEN 0 THEN 'null' WHEN 1 THEN '"' || source || '"' WHEN 2 THEN '"' || lang || ' busy"' WHEN 3 THEN '"' || word || '"'
      WHEN 4 THEN '"Wrong ' || word || '"' WHEN 5 THEN '"family of ' || source || '"' WHEN 6 THEN '" answered"' WHEN 7 THEN '"x"' END AS m1,
    '"payment_disposition":' || CASE n % 7 WHEN 0 THEN 'null' WHEN 1 THEN '"promise to pay"' WHEN 2 THEN '"claims ' || word || '"'
      WHEN 3 THEN '"refused"' WHEN 4 THEN '"' || lang || '"' WHEN 5 THEN '"PTP"' END AS m2,
    '"reason_for_not_paying":' || CASE n % 5 WHEN 0 THEN 'null' WHEN 1 THEN '"job loss of ' || word || '"' WHEN 2 THEN '"' || source || '"'
      WHEN 3 THEN '"FUNDS_ISSUE"' END AS m3,
    '"amount":' || CASE n % 6 WHEN 0 THEN n::VARCHAR WHEN 1 THEN '"' || n || '"' WHEN 2 THEN n || '.75' WHEN 3 THEN '""' WHEN 4 THEN '"Rs ' || n || '"' END AS m4,
    '"date":' || CASE n % 4 WHEN 0 THEN '"' || iso || '"' WHEN 1 THEN '"' || iso || 'T10:00:00"' WHEN 2 THEN '"on ' || iso || '"' ELSE 'null' END AS m5,
    '"confidence_score":' || CASE n % 5 WHEN 0 THEN (n // 1000) || '.' || lpad((n % 1000)::VARCHAR, 3, '0') WHEN 1 THEN '"high"' WHEN 2 THEN 'null'
      WHEN 3 THEN '0.' || lpad((n % 100)::VARCHAR, 2, '0') END AS m6
  FROM dates
),
built AS (
  SELECT *, '{' || concat_ws(',', m1, m2, m3, '"ptp_details":{' || concat_ws(',', m4, m5) || '}', m6, '"remarks":"' || escaped || '"') || '}' AS js FROM members
),
calls AS (
  SELECT doc_id AS k1, '' AS k2, said AS transcript, '' AS today,
    CASE n % 11 WHEN 0 THEN said WHEN 1 THEN left(js, length(js) - 2) WHEN 2 THEN js || ' ' || js WHEN 3 THEN word || ' } ' || js
      ELSE word || ': ' || js || ' - ' || lang END AS g
  FROM built
)"""
ROWS_PARSED = f"{ANSWERED},\n{PARSED}"
CASES_PARSED = f"{RECORDED},\n{PARSED}"
CASES_CLEANED = f"{CASES_PARSED},\n{CLEANED}"
REPLIES_CLEANED = f"{REPLIES},\n{PARSED},\n{CLEANED}"

FLAT = """disposition, payment_disposition, reason_for_not_paying, amount, date,
  length(remarks)::BIGINT AS remarks_chars, md5(remarks) AS remarks_md5,
  round(confidence_score, 6) AS confidence_score, error, raw, failed"""


def oracle(name: str, final: str, *tables: str) -> None:
    ORACLES[name] = ("WITH " + ",\n".join(tables) + "\n" if tables else "") + final


# --- sources, sinks ------------------------------------------------------------------------------

oracle(
    "read_transcripts_csv",
    "SELECT doc_id::VARCHAR AS doc_id, lang, length(text)::BIGINT AS chars, md5(text) AS text_md5 FROM documents",
)
oracle(
    "sniff_transcript_column",
    "SELECT doc_id, 'text' AS transcript_column, md5(text) AS text_md5 FROM documents",
)
oracle(
    "read_gold",
    """SELECT language, count(*)::BIGINT AS records, count(DISTINCT id)::BIGINT AS ids,
  sum(length(filled || ' ' || text))::BIGINT AS transcript_chars, count(exp_amt)::BIGINT AS with_amount
FROM gold GROUP BY language""",
    GOLD,
)
oracle(
    "gold_roundtrip",
    """SELECT language, id, md5(filled || ' ' || text) AS transcript_md5, exp_disp AS expected_disposition,
  exp_pay AS expected_payment_disposition, exp_reason AS expected_reason_for_not_paying,
  exp_amt::BIGINT AS expected_amount, exp_date AS expected_date, 'Generated sample' AS expected_remarks FROM gold""",
    GOLD,
)
oracle("nested_json_column", "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
oracle(
    "unwrap_transcript",
    "SELECT doc_id, length(text)::BIGINT AS chars, md5(text) AS text_md5 FROM documents",
)
oracle(
    "read_transcripts_json",
    "SELECT doc_id, length(text)::BIGINT AS chars, md5(text) AS text_md5 FROM documents",
)
oracle("read_transcripts_json_lines", ORACLES["read_transcripts_json"])
oracle(
    "read_gold_arrays",
    """SELECT language, id, md5(filled || ' ' || text) AS transcript_md5, exp_disp AS expected_disposition,
  exp_amt::BIGINT AS expected_amount, exp_date AS expected_date FROM gold""",
    GOLD,
)
oracle(
    "read_labelled_pairs",
    """SELECT doc_id, upper(source) AS disposition, lang AS payment_disposition, n_chars::VARCHAR AS ptp_amount,
  NULL::VARCHAR AS ptp_date, md5(text) AS remarks_md5 FROM documents""",
)
oracle("read_labelled_pair_arrays", ORACLES["read_labelled_pairs"])
_LINES = """lines AS (
  SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'Agent' WHEN 'user' THEN 'Borrower' WHEN 'system' THEN 'System' END
    || ': ' || coalesce(text, '') AS line FROM conversations
),
whole_calls AS (
  SELECT conv_id, string_agg(line, ' ' ORDER BY turn, line) AS transcript, count(*)::BIGINT AS turns FROM lines GROUP BY conv_id
)"""
oracle("assemble_transcripts", "SELECT conv_id, transcript, turns FROM whole_calls", _LINES)
oracle(
    "assemble_for_prompt",
    """SELECT conv_id, CASE WHEN length(transcript) > 22000 THEN left(transcript, 22000) || '... [TRUNCATED]' ELSE transcript END AS transcript
FROM whole_calls""",
    _LINES,
)
oracle("predictions_roundtrip", f"SELECT k1 AS doc_id, {FLAT} FROM cleaned", CASES_CLEANED)
oracle(
    "predictions_csv_roundtrip",
    # an empty text is null in CSV
    """SELECT cleaned.k1 AS doc_id, disposition, payment_disposition, amount, date, md5(nullif(remarks, '')) AS remarks_md5,
  confidence_score, error, nullif(raw, '') AS raw, md5(nullif(calls.transcript, '')) AS transcript_md5,
  md5(nullif(calls.g, '')) AS generation_md5 FROM cleaned JOIN calls ON calls.k1 = cleaned.k1""",
    CASES_CLEANED,
)

# --- before generation ------------------------------------------------------------------------------

BLANKED = f"""blanked AS (
  SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN ' ' || chr(9) || chr(10) || chr(160) || chr(8195) WHEN doc_id % 20 = 10 THEN '' ELSE text END AS transcript,
    CASE coalesce(length(text), 0) % 3 WHEN 1 THEN '2026-02-' || lpad((coalesce(length(text), 0) % 28 + 1)::VARCHAR, 2, '0') ELSE '{RUN_DATE}' END AS today, doc_id % 10 = 0 AS blank
  FROM documents
),
prompts AS (
  SELECT *, CASE WHEN length(transcript) > 22000 THEN left(transcript, 22000) || '... [TRUNCATED]' ELSE transcript END AS said FROM blanked
),
prompted AS (
  SELECT *, CASE WHEN NOT blank THEN {quoted(INSTRUCTION)} || chr(10) || chr(10) || 'The call took place on ' || today || '.' || chr(10) || 'What was said:' || chr(10) || said || chr(10) || chr(10) || 'JSON object:' || chr(10) END AS prompt
  FROM prompts
)"""
oracle(
    "reject_blank",
    "SELECT doc_id, CASE WHEN blank THEN 'Transcript is empty' END AS request_error, md5(transcript) AS text_md5 FROM blanked",
    BLANKED,
)
oracle("default_current_date", "SELECT doc_id, today AS current_date FROM blanked", BLANKED)
oracle(
    "truncate_transcript",
    """SELECT doc_id, length(said)::BIGINT AS chars, md5(said) AS text_md5 FROM (
  SELECT doc_id, CASE WHEN length(text) > 22000 THEN substr(text, 1, 22000) || '... [TRUNCATED]' ELSE text END AS said FROM documents)""",
)
oracle(
    "render_prompt",
    "SELECT doc_id, length(prompt)::BIGINT AS chars, md5(prompt) AS prompt_md5 FROM prompted",
    BLANKED,
)

# --- generation ---------------------------------------------------------------------------------------

REPLAYED = f"""{CASE_TABLE},
numbered AS (SELECT *, ('0x' || substr(md5(prompt), 1, 8))::BIGINT AS number FROM prompted),
replayed AS (SELECT n.*, gen FROM numbered n LEFT JOIN cases ON case_no = number % {len(CASES)})"""
oracle("generate_replay", "SELECT doc_id, gen AS generation FROM replayed", BLANKED, REPLAYED)
oracle(
    "generate_errors",
    """SELECT doc_id, CASE WHEN number % 7 <> 0 THEN gen END AS generation,
  CASE WHEN number % 7 = 0 THEN 'device fault' END AS generate_error FROM replayed""",
    BLANKED,
    REPLAYED,
)
_REPLAY_CALLS = "calls AS (SELECT doc_id AS k1, '' AS k2, said AS transcript, today, coalesce(gen, '') AS g FROM replayed)"
oracle(
    "predict_batch",
    f"""SELECT doc_id, disposition, payment_disposition, reason_for_not_paying, amount, date, remarks_chars, remarks_md5,
  confidence_score, CASE WHEN blank THEN 'Transcript is empty' ELSE error END AS error,
  CASE WHEN NOT blank THEN raw END AS raw, failed
FROM (SELECT k1, {FLAT} FROM cleaned) JOIN prompted ON doc_id = k1""",
    BLANKED,
    REPLAYED,
    _REPLAY_CALLS,
    PARSED,
    CLEANED,
)
_UPLOADED = BLANKED[: BLANKED.index("prompts AS")].replace(
    BLANKED[: BLANKED.index("prompts AS")],
    f"blanked AS (SELECT doc_id, text AS transcript, '{RUN_DATE}' AS today, false AS blank FROM documents),\n",
) + BLANKED[BLANKED.index("prompts AS") :]
oracle(
    "predict_uploaded_file",
    """SELECT doc_id, disposition, payment_disposition, error, length(p.transcript)::BIGINT AS original_chars
FROM cleaned JOIN prompted p ON doc_id = k1""",
    _UPLOADED,
    REPLAYED,
    _REPLAY_CALLS,
    PARSED,
    CLEANED,
)

# --- parsing ------------------------------------------------------------------------------------------

oracle("slice_json", "SELECT k1 AS doc_id, slice FROM sliced", ROWS_PARSED)
oracle(
    "parse_json_strict",
    "SELECT k1 AS doc_id, parse_error, disp_text AS disposition FROM fields",
    ROWS_PARSED,
)
oracle(
    "route_errors",
    "SELECT error, count(*)::BIGINT AS rows, count(DISTINCT raw)::BIGINT AS raw_texts FROM cleaned GROUP BY error",
    CASES_CLEANED,
)

# --- cleaning -------------------------------------------------------------------------------------------

oracle(
    "normalise_call_label",
    f"SELECT k1 AS doc_id, {DISP_SAID} AS said, {call_label(DISP_SAID)} AS label FROM fields WHERE parse_error IS NULL",
    ROWS_PARSED,
)
oracle(
    "normalise_payment_label",
    f"SELECT k1 AS doc_id, {PAY_SAID} AS said, {pay_label(PAY_SAID)} AS label FROM fields WHERE parse_error IS NULL",
    ROWS_PARSED,
)
oracle(
    "map_reason",
    f"SELECT k1 AS doc_id, {REASON} AS reason FROM fields WHERE parse_error IS NULL",
    ROWS_PARSED,
)
oracle(
    "ptp_struct_guard",
    """SELECT k1 AS doc_id, CASE WHEN amt_type IS NULL THEN 'MISSING' WHEN amt_type = 'VARCHAR' THEN 'STRING'
    WHEN amt_type = 'DOUBLE' THEN 'DECIMAL' ELSE 'BIGINT' END AS amount_kind, amt_text AS amount, date_text AS date
FROM fields WHERE parse_error IS NULL""",
    ROWS_PARSED,
)
oracle(
    "ground_amount",
    f"""SELECT doc_id, whole, CASE WHEN contains(replace(said, ',', ''), whole) THEN whole END AS grounded FROM (
  SELECT doc_id, said, {whole('amount')} AS whole FROM (
    SELECT doc_id, text || ' ' || n_chars || ' or 5,000' AS said,
      CASE doc_id % 6 WHEN 0 THEN '5,000' WHEN 1 THEN n_chars || '.75' WHEN 2 THEN '7000' WHEN 3 THEN '₹5000' WHEN 4 THEN ' 5e3 '
        ELSE n_chars::VARCHAR END AS amount FROM documents))""",
)
DATED = """dated AS (
  SELECT *, text || CASE n % 5 WHEN 0 THEN ' Parso' WHEN 1 THEN ' Kal' ELSE '' END AS transcript,
    CASE n % 4 WHEN 0 THEN iso WHEN 1 THEN iso || 'T10:00:00' WHEN 2 THEN iso || ' at noon' ELSE 'on ' || iso END AS written,
    CASE n % 7 WHEN 0 THEN '2026-2-3' WHEN 1 THEN '2026-02-30' WHEN 2 THEN 'soon' ELSE iso END AS today
  FROM (SELECT doc_id, text, n, '2026-' || lpad((n % 14)::VARCHAR, 2, '0') || '-' || lpad((n % 33)::VARCHAR, 2, '0') AS iso
    FROM (SELECT doc_id, text, coalesce(length(text), 0) AS n FROM documents))
)"""
oracle(
    "resolve_relative_date",
    f"SELECT doc_id, {relative('iso', 'lower(transcript)', '(' + reference('today') + ')', 'today')} AS date FROM dated",
    DATED,
)
oracle("extract_iso_date", f"SELECT doc_id, {iso('written')} AS date FROM dated", DATED)
oracle("cap_month_end", f"SELECT doc_id, iso, {capped('iso')} AS date FROM dated", DATED)
oracle(
    "validate_reference_date",
    f"SELECT doc_id, ({reference('today')})::VARCHAR AS reference FROM dated",
    DATED,
)
oracle(
    "gate_ptp",
    """SELECT payment_disposition, count(*)::BIGINT AS rows, count(amount)::BIGINT AS amounts, count(date)::BIGINT AS dates
FROM cleaned GROUP BY payment_disposition""",
    CASES_CLEANED,
)
oracle(
    "policy_downgrade",
    "SELECT k1 AS doc_id, payment_disposition, remarks, error FROM cleaned",
    CASES_CLEANED,
)
oracle(
    "clamp_confidence",
    f"SELECT k1 AS doc_id, {CONFIDENCE} AS confidence FROM fields WHERE parse_error IS NULL",
    ROWS_PARSED,
)
oracle("clean_output", f"SELECT k1 AS doc_id, {FLAT} FROM cleaned", CASES_CLEANED)
oracle("stream_dispositions", f"SELECT k1 AS doc_id, {FLAT} FROM cleaned", CASES_CLEANED)
oracle(
    "clean_replies",
    f"SELECT k2 AS language, k1 AS id, {FLAT.replace(', raw,', ', length(raw)::BIGINT AS raw,')} FROM cleaned",
    REPLIES_CLEANED,
)
oracle(
    "extra_keys",
    "SELECT event_id, 'OTHERS' AS disposition, array_to_string(json_keys(props), ',') AS extra_keys, props ->> '$.k' AS k FROM events",
)

# --- evaluation -------------------------------------------------------------------------------------------

MATCHED = f"""{REPLIES_CLEANED},
sides AS (SELECT * FROM gold JOIN cleaned ON id = k1),
matched AS (
  SELECT *, NOT failed AND disposition IS NOT DISTINCT FROM exp_disp AS match_disposition,
    NOT failed AND (payment_disposition IS NOT DISTINCT FROM exp_pay
      OR coalesce(payment_disposition IN ('PTP', 'PARTIAL_PAYMENT') AND exp_pay IN ('PTP', 'PARTIAL_PAYMENT'), false)) AS match_payment,
    NOT failed AND coalesce(reason_for_not_paying, 'None') = coalesce(exp_reason, 'None') AS match_reason,
    NOT failed AND coalesce(amount, 'None') = coalesce(exp_amt::VARCHAR, 'None') AS match_amount,
    NOT failed AND ((date IS NULL) = (exp_date IS NULL) OR (coalesce(date, 'None') = 'None' AND coalesce(exp_date, 'None') = 'None')) AS match_date
  FROM sides
),
exact AS (SELECT *, match_disposition AND match_payment AND match_reason AND match_amount AND match_date AS exact_match FROM matched),
accuracies AS (
  SELECT language, count(*)::BIGINT AS total,
    {', '.join(f'100.0 * count(*) FILTER (match_{m}) / count(*) AS {m}' for m in ('disposition', 'payment', 'reason', 'amount', 'date'))}
  FROM exact GROUP BY language
),
overall AS (SELECT *, (disposition + payment + reason + amount + date) / 5 AS overall FROM accuracies)"""
_MEASURES = ("disposition", "payment", "reason", "amount", "date")
oracle(
    "eval_pairs",
    """SELECT language, id, md5(transcript) AS transcript_md5, exp_disp AS gold_disp, exp_pay AS gold_pay, exp_reason AS gold_reason,
  exp_amt::VARCHAR AS gold_amt, exp_date AS gold_date, disposition AS predicted_disp, payment_disposition AS predicted_pay,
  reason_for_not_paying AS predicted_reason, amount AS predicted_amt, date AS predicted_date, exact_match AS is_exact_match,
  md5(remarks) AS remarks_md5 FROM exact WHERE NOT failed""",
    MATCHED,
)
oracle(
    "match_fields",
    f"SELECT language, id, {', '.join(f'match_{m}' for m in _MEASURES)} FROM matched",
    MATCHED,
)
oracle("exact_match", "SELECT language, id, exact_match FROM exact", MATCHED)
oracle(
    "accuracy_by_language",
    f"SELECT language, total, {', '.join(f'round({m}, 6) AS {m}' for m in _MEASURES)} FROM accuracies",
    MATCHED,
)
oracle("overall_accuracy", "SELECT language, round(overall, 6) AS overall FROM overall", MATCHED)
oracle(
    "format_report",
    f"""SELECT language, printf('%-10s{' | %5.0f%%' * 6}', upper(language[1]) || lower(language[2:]),
  {', '.join(f'round_even({m}, 0)' for m in (*_MEASURES, 'overall'))}) AS line FROM overall""",
    MATCHED,
)


def _pair(*columns: str) -> str:
    return " || ', ' || ".join(f"coalesce({column}::VARCHAR, 'None')" for column in columns)


oracle(
    "mismatch_report",
    f"""SELECT language, id, left(transcript, 50) || '...' AS transcript_start, field, expected, predicted FROM (
  SELECT *, 'labels' AS field, {_pair('exp_disp', 'exp_pay')} AS expected, {_pair('disposition', 'payment_disposition')} AS predicted
  FROM exact WHERE NOT (match_disposition AND match_payment)
  UNION ALL
  SELECT *, 'reason', {_pair('exp_reason')}, {_pair('reason_for_not_paying')} FROM exact WHERE NOT match_reason
  UNION ALL
  SELECT *, 'promise', {_pair('exp_amt', 'exp_date')}, {_pair('amount', 'date')} FROM exact WHERE NOT (match_amount AND match_date)
) WHERE NOT failed""",
    MATCHED,
)
oracle(
    "json_validity_rate",
    """SELECT count(*)::BIGINT AS total, count(parse_error)::BIGINT AS errors,
  round(100.0 * (count(*) - count(parse_error)) / count(*), 6) AS validity_rate FROM parsed""",
    ROWS_PARSED,
)
LABELLED = f"""{CASES_CLEANED},
aligned AS (
  SELECT doc_id, CASE WHEN toxic = 1 THEN 'CUSTOMER_ABUSIVE' WHEN quality = 1 THEN 'ANSWERED' ELSE 'OTHERS' END AS gold,
    disposition AS pred, coalesce(failed, true) AS failed
  FROM labels LEFT JOIN cleaned ON doc_id = k1
),
valid AS (SELECT * FROM aligned WHERE NOT failed),
names AS (SELECT gold AS label FROM valid UNION SELECT pred FROM valid),
counted AS (
  SELECT label, (SELECT count(*) FROM valid WHERE gold = label AND pred = label) AS hits,
    (SELECT count(*) FROM valid WHERE gold = label) AS support, (SELECT count(*) FROM valid WHERE pred = label) AS predictions
  FROM names
),
measured AS (
  SELECT *, CASE WHEN predictions > 0 THEN hits / predictions ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM counted
),
report AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM measured
)"""
oracle(
    "align_gold",
    "SELECT doc_id, gold AS expected_disposition, pred AS disposition, failed FROM aligned",
    LABELLED,
)
oracle(
    "strict_accuracy",
    "SELECT count(*)::BIGINT AS valid, round(100.0 * count(*) FILTER (gold = pred) / count(*), 6) AS accuracy FROM valid",
    LABELLED,
)
oracle(
    "classification_report",
    "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM report",
    LABELLED,
)
oracle(
    "report_averages",
    """SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall,
  round(avg(f1), 6) AS macro_f1, round(sum(precision * support) / sum(support), 6) AS weighted_precision,
  round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
  sum(support)::BIGINT AS support FROM report""",
    LABELLED,
)
oracle(
    "top_confusions",
    """SELECT gold, pred AS predicted, count(*)::BIGINT AS pairs FROM valid WHERE gold <> pred
GROUP BY gold, pred ORDER BY pairs DESC, gold, pred LIMIT 10""",
    LABELLED,
)
oracle(
    "ptp_kpis",
    """SELECT count(*)::BIGINT AS gold_promises, round(100.0 * count(*) FILTER (match_amount) / count(*), 6) AS amount_accuracy,
  round(100.0 * count(*) FILTER (NOT failed AND date = exp_date) / count(*), 6) AS date_accuracy,
  round(100.0 * count(*) FILTER (NOT failed AND payment_disposition = 'PTP') / count(*), 6) AS ptp_recall
FROM exact WHERE exp_pay = 'PTP'""",
    MATCHED,
)
oracle(
    "audit_agent_labels",
    """SELECT doc_id, agent_disposition, disposition FROM (
  SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'ANSWERED' ELSE 'OTHERS' END AS agent_disposition FROM documents)
JOIN cleaned ON doc_id = k1 WHERE NOT failed AND agent_disposition <> disposition""",
    CASES_CLEANED,
)
oracle(
    "payment_reminders",
    """SELECT date AS ptp_date, count(*)::BIGINT AS promises, count(amount)::BIGINT AS with_amount, sum(amount::DOUBLE) AS amount_due
FROM cleaned WHERE NOT failed AND payment_disposition = 'PTP' AND TRY_CAST(date AS DATE) IS NOT NULL GROUP BY date""",
    REPLIES_CLEANED,
)
oracle(
    "oversample_keywords",
    """SELECT doc_id, copy_no::BIGINT AS copy_no, length(text)::BIGINT AS chars FROM documents,
  (SELECT unnest([1, 2, 3]) AS copy_no)
WHERE copy_no = 1 OR contains(lower(text), 'parso') OR contains(lower(text), 'kal') OR contains(lower(text), 'the')""",
)

# --- gold data --------------------------------------------------------------------------------------------

oracle(
    "synth_gold_counts",
    """SELECT language, exp_disp AS expected_disposition, exp_pay AS expected_payment_disposition, count(*)::BIGINT AS records,
  count(exp_amt)::BIGINT AS with_amount FROM gold GROUP BY ALL""",
    GOLD,
)
oracle("fill_template", "SELECT id, scenario, filled AS transcript FROM gold", GOLD)
oracle(
    "scenario_truth",
    """SELECT id, scenario, exp_disp AS expected_disposition, exp_pay AS expected_payment_disposition,
  exp_reason AS expected_reason_for_not_paying, exp_amt::BIGINT AS expected_amount, exp_date AS expected_date FROM gold""",
    GOLD,
)

# --- request metrics ----------------------------------------------------------------------------------------

LOG = """log AS (
  SELECT event_id, user_id % 3 AS level, ts AS start, value AS latency, event_type <> 'error' AS good,
    event_type = 'error' AND (props ->> '$.k')::BIGINT % 2 = 1 AS blank,
    epoch_us(ts) / 1e6 AS start_s
  FROM events
),
ranked AS (
  SELECT level, latency, row_number() OVER (PARTITION BY level ORDER BY latency) AS rank, count(*) OVER (PARTITION BY level) AS n
  FROM log WHERE good
)"""


def exclusive(numerator: int, denominator: int) -> str:
    """Quantile by rank p(n+1) over ``ranked``, with the lower rank kept within 1..n-1."""
    low = f"greatest(least({numerator} * (n + 1) // {denominator}, n - 1), 1)"
    weight = f"({numerator} * (max(n) + 1) - max({low}) * {denominator})"
    return (
        f"(max(latency) FILTER (rank = {low}) * ({denominator} - {weight}) + "
        f"max(latency) FILTER (rank = least({low} + 1, n)) * {weight}) / {denominator}"
    )


SUCCESS = """count(*)::BIGINT AS total, count(*) FILTER (good)::BIGINT AS successes, count(*) FILTER (NOT good)::BIGINT AS errors"""
oracle(
    "success_rate",
    f"""SELECT {SUCCESS}, round(100.0 * count(*) FILTER (good) / count(*), 6) AS success_rate,
  round(100.0 - 100.0 * count(*) FILTER (good) / count(*), 6) AS error_rate FROM log""",
    LOG,
)
oracle(
    "latency_stats",
    """SELECT level, count(*)::BIGINT AS successes, round(avg(latency), 6) AS mean, round(median(latency), 6) AS median,
  round(min(latency), 6) AS min, round(max(latency), 6) AS max FROM log WHERE good GROUP BY level""",
    LOG,
)
oracle(
    "latency_quantiles",
    f"""SELECT level, count(*)::BIGINT AS successes, round(CASE WHEN count(*) >= 5 THEN {exclusive(9, 10)} END, 6) AS p90,
  round(CASE WHEN count(*) >= 5 THEN {exclusive(19, 20)} END, 6) AS p95 FROM ranked GROUP BY level""",
    LOG,
)
oracle(
    "load_sweep",
    f"""SELECT level, total, successes, errors, success_rate, wall_seconds, mean, median, p90, p95, min, max FROM (
  SELECT level, {SUCCESS}, round(100.0 * count(*) FILTER (good) / count(*), 4) AS success_rate,
    round(max(start_s + latency) - min(start_s), 4) AS wall_seconds FROM log GROUP BY level)
LEFT JOIN (
  SELECT level, round(avg(latency), 4) AS mean, round(median(latency), 4) AS median, round({exclusive(9, 10)}, 4) AS p90,
    round({exclusive(19, 20)}, 4) AS p95, round(min(latency), 4) AS min, round(max(latency), 4) AS max FROM ranked GROUP BY level)
USING (level)""",
    LOG,
)
oracle(
    "request_counters",
    "SELECT count(*)::BIGINT AS requests, count(*) FILTER (NOT good OR blank)::BIGINT AS request_errors FROM log",
    LOG,
)
oracle(
    "latency_histogram",
    f"""SELECT le, (SELECT count(*) FROM log WHERE NOT blank AND latency <= le::DOUBLE)::BIGINT AS cumulative,
  (SELECT round(sum(latency), 4) FROM log WHERE NOT blank) AS sum, (SELECT count(*) FROM log WHERE NOT blank)::BIGINT AS count
FROM (SELECT unnest([{listed([*map(str, DEFAULT_BOUNDS), 'inf'])}]) AS le)""",
    LOG,
)
_GAUGES = """SELECT (user_id % 8)::VARCHAR AS gpu, arg_max((props ->> '$.k')::DOUBLE, ts) AS util, 15360.0::DOUBLE AS mem_total,
  arg_max(floor(value * 10)::DOUBLE, ts) AS mem_used FROM events WHERE event_type <> 'signup' GROUP BY gpu"""
oracle("gpu_gauges", _GAUGES)
oracle("stream_latest_gauge", _GAUGES)
_AVAILABLE = """WITH polls AS (
  SELECT (user_id % 8)::VARCHAR AS gpu, ts::TIMESTAMP AS ts, bool_and(event_type <> 'signup') AS ok FROM events GROUP BY ALL
),
in_turn AS (
  SELECT *, lag(ts) OVER w AS earlier, lag(ok) OVER w AS was_ok, coalesce(lead(ts) OVER w, (SELECT max(ts) FROM polls)) AS upto
  FROM polls WINDOW w AS (PARTITION BY gpu ORDER BY ts)
)
SELECT gpu, strftime(since, '%Y-%m-%d %H:%M:%S.%f') AS since, available FROM (
  SELECT gpu, ts AS since, ok AS available FROM in_turn WHERE earlier IS NULL OR (was_ok AND earlier + INTERVAL 10 MINUTE >= ts) <> ok
  UNION ALL
  SELECT gpu, ts + INTERVAL 10 MINUTE, false FROM in_turn WHERE ok AND ts + INTERVAL 10 MINUTE < upto)"""
oracle("gpu_availability", _AVAILABLE)
oracle("stream_gpu_availability", _AVAILABLE)
oracle(
    "throughput",
    """SELECT level, calls, round(seconds, 4) AS seconds, round(calls / seconds * 60, 4) AS calls_per_minute,
  round(calls / seconds * 3600, 4) AS calls_per_hour
FROM (SELECT level, count(*)::BIGINT AS calls, max(start_s + latency) - min(start_s) AS seconds FROM log GROUP BY level)""",
    LOG,
)
WINDOWS = f"""{LOG},
windows AS (
  SELECT date_trunc('hour', start) AS w, {SUCCESS}, count(*) FILTER (NOT good OR blank)::BIGINT AS request_errors,
    round(100.0 * count(*) FILTER (good) / count(*), 6) AS success_rate, round(avg(latency) FILTER (good), 6) AS mean_latency,
    round(max(latency) FILTER (good), 6) AS max_latency
  FROM log GROUP BY w
)"""
_STAMP = "'%Y-%m-%d %H:%M:%S'"
oracle(
    "stream_request_metrics",
    f"""SELECT strftime(w, {_STAMP}) AS window_start, strftime(w + INTERVAL 1 HOUR, {_STAMP}) AS window_end, total, successes,
  request_errors, success_rate, mean_latency, max_latency FROM windows""",
    WINDOWS,
)
oracle(
    "stream_metrics_append",
    f"""SELECT strftime(w, {_STAMP}) AS window_start, total, request_errors FROM windows""",
    WINDOWS,
)
