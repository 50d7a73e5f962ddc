"""Oracle SQL for the shift and case drill-downs (all keys at once)."""

from __future__ import annotations

from oracle.prelude import micros, r2, r2_int, with_prelude

MIN_US = "60000000"

# Columns of the case table, and of a consultation with the
# names they have in the result.
CASE_COLUMNS = (
    "caseno",
    "active_date",
    "location",
    "sex",
    "age",
    "call_origin",
    "clinical_codes",
    "comfort_call",
    "dx_outcome",
    "received_case_type",
    "finished_case_type",
    "priority_on_reception",
    "priority_after_assessment",
    "priority_on_completion",
    "od_start_time",
    "od_finish_time",
    "ccg",
    "provider_group",
    "informational_outcome",
    "cons_delay",
    "od_cons_delay",
    "cons_delayafter_assess",
)

CONSULTATION_COLUMNS = (
    ("rslid", "rslid"),
    ("case_type", "case_type"),
    ("active_date", "cons_active_date"),
    ("call_origin", "cons_call_origin"),
    ("location_name", "location_name"),
    ("operator_who_received_case", "operator_who_received_case"),
    ("receive_time", "receive_time"),
    ("reported_condition", "reported_condition"),
    ("priority_on_reception", "cons_priority_reception"),
    ("priority_after_assessment", "cons_priority_assessment"),
    ("priority_on_completion", "cons_priority_completion"),
    ("patient_audit_allergy", "patient_audit_allergy"),
    ("patient_audit_condition", "patient_audit_condition"),
    ("patient_audit_medication", "patient_audit_medication"),
    ("cons_type", "cons_type"),
    ("next_cons_type", "next_cons_type"),
    ("cons_begin_time", "cons_begin_time"),
    ("cons_end_time", "cons_end_time"),
    ("cons_clinicians_name", "cons_clinicians_name"),
    ("cons_history", "cons_history"),
    ("cons_examination", "cons_examination"),
    ("cons_diagnosis", "cons_diagnosis"),
    ("cons_treatment", "cons_treatment"),
    ("clinical_codes", "cons_clinical_codes"),
    ("cons_prescriptions", "cons_prescriptions"),
    ("prescriptions", "prescriptions"),
    ("informational_outcomes", "informational_outcomes"),
)

# a shift's consultations, then the shifts that have none
SHIFT_DETAIL = f"""timed AS (
  SELECT rslid, caseno AS case_number, cons_type AS consultation_type, next_cons_type AS next_consultation_type,
         cons_begin_time AS consultation_start, cons_end_time AS consultation_end,
         {r2(micros('cons_begin_time', 'cons_end_time'), MIN_US)} AS consultation_duration_mins,
         {r2_int(micros('cons_begin_time', 'cons_end_time'), MIN_US)} AS mins_x100
  FROM consultations WHERE rslid IS NOT NULL
),
shifts AS (SELECT personid, rslid, truelogin AS shift_start_time, truelogout AS shift_end_time FROM rotas),
detail AS (
  SELECT * FROM shifts JOIN timed USING (rslid)
  UNION ALL BY NAME
  SELECT * FROM shifts ANTI JOIN timed USING (rslid)
)"""


def shift_detail() -> str:
    return with_prelude(
        """SELECT personid, rslid, shift_start_time, shift_end_time, case_number, consultation_type,
       next_consultation_type, consultation_start, consultation_end, consultation_duration_mins
FROM detail""",
        SHIFT_DETAIL,
    )


def shift_kpis() -> str:
    return with_prelude(
        """SELECT rslid,
       COUNT(DISTINCT case_number) AS total_cases,
       COALESCE(CAST(SUM(mins_x100) AS DOUBLE) / 100, 0.0) AS total_consultation_mins,
       (CAST(SUM(mins_x100) AS DOUBLE) / 100) / CAST(NULLIF(COUNT(mins_x100), 0) AS DOUBLE) AS avg_consultation_mins
FROM detail
GROUP BY rslid""",
        SHIFT_DETAIL,
    )


def shift_type_counts() -> str:
    return with_prelude(
        """SELECT rslid, consultation_type, COUNT(*) AS consultation_count
FROM detail
WHERE consultation_type IS NOT NULL
GROUP BY rslid, consultation_type""",
        SHIFT_DETAIL,
    )


def _case_detail_cte() -> str:
    case_cols = ", ".join(CASE_COLUMNS)
    cons_cols = ", ".join(f"{src} AS {out}" for src, out in CONSULTATION_COLUMNS)
    renamed = ", ".join(out for _, out in CONSULTATION_COLUMNS)
    # consultations with their clinician, cases with their surveys, then both by case
    return f"""seen AS (
  SELECT caseno, {cons_cols},
         {r2(micros('cons_begin_time', 'cons_end_time'), MIN_US)} AS consultation_duration_mins
  FROM consultations
),
seen_by AS (
  SELECT seen.*, personid AS clinician_personid
  FROM seen LEFT JOIN (SELECT personid, adastra FROM users WHERE adastra IS NOT NULL) AS who
    ON who.adastra = seen.cons_clinicians_name
),
rated AS (
  SELECT {", ".join("cases." + n for n in CASE_COLUMNS)}, satisfaction, comments AS survey_comments
  FROM cases LEFT JOIN (SELECT caseno, satisfaction, comments FROM surveys) AS s USING (caseno)
),
case_rows AS (
  SELECT {case_cols}, clinician_personid, {renamed}, satisfaction, survey_comments, consultation_duration_mins
  FROM seen_by RIGHT JOIN rated USING (caseno)
)"""


def case_detail() -> str:
    return with_prelude("SELECT * FROM case_rows", _case_detail_cte())


def case_header() -> str:
    ranked = """ranked AS (
  SELECT *, ROW_NUMBER() OVER (
    PARTITION BY caseno ORDER BY cons_begin_time ASC NULLS LAST, cons_end_time ASC NULLS LAST) AS rn
  FROM case_rows
)"""
    return with_prelude(
        """SELECT caseno, consultation_duration_mins, age, location, sex, dx_outcome, received_case_type,
       finished_case_type, priority_on_reception, priority_after_assessment, priority_on_completion
FROM ranked WHERE rn = 1""",
        _case_detail_cte() + ",\n" + ranked,
    )


def case_consultations() -> str:
    order = ", ".join(
        f"{c} ASC NULLS LAST"
        for c in (
            "cons_begin_time",
            "cons_end_time",
            "cons_type",
            "cons_clinicians_name",
            "cons_diagnosis",
            "cons_treatment",
            "satisfaction",
            "survey_comments",
        )
    )
    return with_prelude(
        f"""SELECT caseno, cons_begin_time, cons_end_time, received_case_type AS consultation_type, cons_type,
       cons_clinicians_name, cons_diagnosis, cons_treatment, satisfaction, survey_comments,
       ROW_NUMBER() OVER (PARTITION BY caseno ORDER BY {order}) AS consultation_no
FROM case_rows""",
        _case_detail_cte(),
    )


def survey_feedback() -> str:
    return with_prelude(
        """SELECT caseno, cons_begin_time, satisfaction, survey_comments
FROM case_rows
WHERE satisfaction IS NOT NULL OR survey_comments IS NOT NULL""",
        _case_detail_cte(),
    )
