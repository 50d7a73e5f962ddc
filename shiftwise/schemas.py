"""Explicit schemas of the six operational tables (no inference)."""

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


S, L, I, D, T = StringType(), LongType(), IntegerType(), DoubleType(), TimestampNTZType()

USERS = _schema(("personid", L), ("fullname", S), ("adastra", S))

ROTAS = _schema(
    ("rslid", L),
    ("personid", L),
    ("date", T),
    ("truelogin", T),
    ("truelogout", T),
    ("duration", S),
    ("durationdecimal", D),
    ("value", S),
    ("role", S),
    ("dutystation", S),
    ("status", S),
)

CONSULTATIONS = _schema(
    ("caseno", L),
    ("rslid", L),
    ("case_type", S),
    ("active_date", T),
    ("call_origin", S),
    ("location_name", S),
    ("operator_who_received_case", S),
    ("receive_time", T),
    ("reported_condition", S),
    ("priority_on_reception", S),
    ("priority_after_assessment", S),
    ("priority_on_completion", S),
    ("patient_audit_allergy", S),
    ("patient_audit_condition", S),
    ("patient_audit_medication", S),
    ("cons_type", S),
    ("next_cons_type", S),
    ("cons_begin_time", T),
    ("cons_end_time", T),
    ("cons_clinicians_name", S),
    ("cons_history", S),
    ("cons_examination", S),
    ("cons_diagnosis", S),
    ("cons_treatment", S),
    ("clinical_codes", S),
    ("cons_prescriptions", S),
    ("prescriptions", S),
    ("informational_outcomes", S),
)

CASES = _schema(
    ("caseno", L),
    ("active_date", T),
    ("location", S),
    ("sex", S),
    ("age", I),
    ("call_origin", S),
    ("clinical_codes", S),
    ("comfort_call", S),
    ("dx_outcome", S),
    ("received_case_type", S),
    ("finished_case_type", S),
    ("priority_on_reception", S),
    ("priority_after_assessment", S),
    ("priority_on_completion", S),
    ("od_start_time", T),
    ("od_finish_time", T),
    ("ccg", S),
    ("provider_group", S),
    ("informational_outcome", S),
    ("cons_delay", S),
    ("od_cons_delay", S),
    ("cons_delayafter_assess", S),
)

SURVEYS = _schema(("caseno", L), ("satisfaction", I), ("comments", S))

PHONE_CALLS = _schema(
    ("start_time", T),
    ("agent_number", L),
    ("direction", S),
    ("duration_talk", I),
)

ALL = {
    "users": USERS,
    "rotas": ROTAS,
    "consultations": CONSULTATIONS,
    "cases": CASES,
    "surveys": SURVEYS,
    "phone_calls": PHONE_CALLS,
}
