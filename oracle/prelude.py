"""DuckDB CTEs that derive the six operational tables from the base views.

Written separately from the Spark derivation (shiftwise.sources.fixtures),
so the two cross-check each other.
"""

from __future__ import annotations


def ctype(x: str) -> str:
    return (
        f"CASE CAST({x} % 9 AS INTEGER) WHEN 0 THEN 'GP Advice' WHEN 1 THEN 'Advice' "
        "WHEN 2 THEN 'NWAS Triage' WHEN 3 THEN 'Treatment Centre' "
        "WHEN 4 THEN 'CAS Treatment Centre - BARDOC' WHEN 5 THEN 'Visit' "
        "WHEN 6 THEN 'HMR VH Visit' WHEN 7 THEN 'Pharmacist Advice' END"
    )


def login(k: str) -> str:
    return (
        f"(TIMESTAMP '2023-12-15 00:00:00' + to_hours(CAST({k} * 37 % 1440 AS BIGINT))"
        f" + to_minutes(CAST({k} * 7 % 60 AS BIGINT)))"
    )


def _nulls(names: str, dtype: str) -> str:
    return ", ".join(f"CAST(NULL AS {dtype}) AS {n.strip()}" for n in names.split(","))


_CONS_TEXT_1 = "case_type"
_CONS_TEXT_2 = (
    "call_origin, location_name, operator_who_received_case"
)
_CONS_TEXT_3 = (
    "reported_condition, priority_on_reception, priority_after_assessment, priority_on_completion, "
    "patient_audit_allergy, patient_audit_condition, patient_audit_medication"
)
_CONS_TEXT_4 = (
    "cons_history, cons_examination, cons_diagnosis, cons_treatment, clinical_codes, "
    "cons_prescriptions, prescriptions, informational_outcomes"
)
_CASE_TEXT_1 = "call_origin, clinical_codes, comfort_call, dx_outcome"
_CASE_TEXT_2 = "priority_after_assessment, priority_on_completion"
_CASE_TEXT_3 = "ccg, provider_group, informational_outcome, cons_delay, od_cons_delay, cons_delayafter_assess"

PRELUDE = f"""
users AS (
  SELECT c.c_custkey AS personid, c.c_name AS fullname, s.s_name AS adastra
  FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey
),
rota_src AS (
  SELECT o.*, {login('o_orderkey')} AS login_ts, 240 + 30 * (o_orderkey % 17) AS shift_mins
  FROM orders o
),
rotas AS (
  SELECT
    o_orderkey AS rslid,
    o_custkey AS personid,
    CAST(date_trunc('day', login_ts) AS TIMESTAMP) AS date,
    login_ts AS truelogin,
    CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE login_ts + to_minutes(CAST(shift_mins AS BIGINT)) END AS truelogout,
    CASE
      WHEN o_orderkey % 97 = 0 THEN 'n/a'
      WHEN o_orderkey % 3 = 0 THEN lpad(CAST(CAST(floor(shift_mins / 60) AS INTEGER) AS VARCHAR), 2, '0')
        || ':' || lpad(CAST(shift_mins % 60 AS VARCHAR), 2, '0')
      ELSE lpad(CAST(CAST(floor(shift_mins / 60) AS INTEGER) AS VARCHAR), 2, '0')
        || ':' || lpad(CAST(shift_mins % 60 AS VARCHAR), 2, '0') || ':00'
    END AS duration,
    CAST(4 + (o_orderkey % 17) / 2.0 AS DOUBLE) AS durationdecimal,
    CASE WHEN o_orderkey % 40 = 0 THEN '' ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) END AS value,
    CASE o_orderpriority
      WHEN '1-URGENT' THEN 'Call Handler' WHEN '2-HIGH' THEN 'GP' WHEN '3-MEDIUM' THEN 'Nurse'
      WHEN '4-NOT SPECIFIED' THEN 'Driver' ELSE 'Pharmacist' END AS role,
    o_orderstatus AS dutystation,
    CASE o_orderkey % 3 WHEN 0 THEN 'Confirmed' WHEN 1 THEN 'Pending' ELSE 'Cancelled' END AS status
  FROM rota_src
),
cons_src AS (
  SELECT l.*, {login('l_orderkey')} + to_minutes(CAST(20 * l_linenumber AS BIGINT)) AS begin_ts
  FROM lineitem l
),
consultations AS (
  SELECT
    2 * l_orderkey + l_linenumber % 2 AS caseno,
    l_orderkey AS rslid,
    {_nulls(_CONS_TEXT_1, 'VARCHAR')},
    CAST(NULL AS TIMESTAMP) AS active_date,
    {_nulls(_CONS_TEXT_2, 'VARCHAR')},
    CAST(NULL AS TIMESTAMP) AS receive_time,
    {_nulls(_CONS_TEXT_3, 'VARCHAR')},
    {ctype('l_partkey')} AS cons_type,
    {ctype('l_suppkey')} AS next_cons_type,
    begin_ts AS cons_begin_time,
    begin_ts + to_minutes(CAST(l_quantity AS BIGINT)) + to_seconds(CAST(l_suppkey % 60 AS BIGINT)) AS cons_end_time,
    'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS cons_clinicians_name,
    {_nulls(_CONS_TEXT_4, 'VARCHAR')}
  FROM cons_src
),
cases AS (
  SELECT
    2 * o_orderkey + t.b AS caseno,
    o_orderdate AS active_date,
    o_orderstatus AS location,
    CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
    CAST(o_custkey % 90 AS INTEGER) AS age,
    {_nulls(_CASE_TEXT_1, 'VARCHAR')},
    {ctype('o_custkey')} AS received_case_type,
    {ctype('o_orderkey')} AS finished_case_type,
    o_orderpriority AS priority_on_reception,
    {_nulls(_CASE_TEXT_2, 'VARCHAR')},
    CAST(NULL AS TIMESTAMP) AS od_start_time,
    CAST(NULL AS TIMESTAMP) AS od_finish_time,
    {_nulls(_CASE_TEXT_3, 'VARCHAR')}
  FROM orders CROSS JOIN (VALUES (0), (1)) AS t(b)
),
surveys AS (
  SELECT doc_id AS caseno,
         CAST(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1 + 3 * quality + toxic END AS INTEGER) AS satisfaction,
         CASE WHEN quality = 1 THEN 'helpful' END AS comments
  FROM labels
  UNION ALL
  SELECT doc_id, 3, 'follow-up' FROM labels WHERE doc_id % 7 = 0
),
phone_calls AS (
  SELECT ts AS start_time, user_id AS agent_number,
         CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'INBOUND' ELSE 'OUTBOUND' END AS direction,
         CAST(floor(value * 6) AS INTEGER) AS duration_talk
  FROM events
)"""


def with_prelude(body: str, ctes: str = "") -> str:
    """Full statement: the derived tables, optional extra CTEs, then ``body``."""
    extra = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
    return f"WITH {PRELUDE.strip()}{extra}\n{body.strip()}"


# --- exact arithmetic snippets (DuckDB turns DECIMAL / x into DOUBLE) ---------


def r2_int(num: str, den: str) -> str:
    """ROUND(num / den, 2) * 100 as an integer (half away from zero), for
    integer num and den > 0; null when either is null."""
    n = f"CAST({num} AS HUGEINT)"
    d = f"CAST({den} AS HUGEINT)"
    return f"(CASE WHEN {n} < 0 THEN -((-{n} * 200 + {d}) // (2 * {d})) ELSE ({n} * 200 + {d}) // (2 * {d}) END)"


def r2(num: str, den: str) -> str:
    """ROUND(num / den, 2) as DOUBLE (see r2_int)."""
    return f"(CAST({r2_int(num, den)} AS DOUBLE) / 100)"


def cents(dec: str) -> str:
    """A DECIMAL already rounded to 2 places → integer hundredths."""
    return f"CAST({dec} * 100 AS HUGEINT)"


def micros(begin: str, end: str) -> str:
    return f"date_diff('microsecond', {begin}, {end})"


def ts(text: str) -> str:
    return f"TIMESTAMP '{text}'"
