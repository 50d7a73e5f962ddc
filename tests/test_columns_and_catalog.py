"""All columns of a case by name, numbers of repeated rows, tables of a catalog."""

from datetime import datetime, timedelta

from shiftwise import schemas
from shiftwise.plans import cases, clinicians, hourly
from shiftwise.sources.snapshot import write_bucketed
from shiftwise.sources.tables import Tables
from tests.util import make_tables, plan_text, rows

T0 = datetime(2024, 1, 5, 8)

# Column of the result, table and column that it shows.
CASE_SOURCE = {
    c: ("cases", c)
    for c in """caseno active_date location sex age call_origin clinical_codes comfort_call dx_outcome received_case_type
    finished_case_type priority_on_reception priority_after_assessment priority_on_completion od_start_time od_finish_time ccg
    provider_group informational_outcome cons_delay od_cons_delay cons_delayafter_assess""".split()
}
CONS_SOURCE = {
    c: ("consultations", c)
    for c in """rslid case_type location_name operator_who_received_case receive_time reported_condition
    patient_audit_allergy patient_audit_condition patient_audit_medication cons_type next_cons_type cons_begin_time cons_end_time
    cons_clinicians_name cons_history cons_examination cons_diagnosis cons_treatment cons_prescriptions prescriptions
    informational_outcomes""".split()
} | {
    "cons_active_date": ("consultations", "active_date"),
    "cons_call_origin": ("consultations", "call_origin"),
    "cons_priority_reception": ("consultations", "priority_on_reception"),
    "cons_priority_assessment": ("consultations", "priority_after_assessment"),
    "cons_priority_completion": ("consultations", "priority_on_completion"),
    "cons_clinical_codes": ("consultations", "clinical_codes"),
}
OTHER_SOURCE = {
    "clinician_personid": ("users", "personid"),
    "satisfaction": ("surveys", "satisfaction"),
    "survey_comments": ("surveys", "comments"),
}


def distinct_row(table, start):
    """A row in which no two columns have the same value."""
    out = {}
    for i, f in enumerate(schemas.ALL[table].fields, start):
        kind = f.dataType.simpleString()
        out[f.name] = T0 + timedelta(minutes=i) if kind == "timestamp_ntz" else f"{table}.{f.name}" if kind == "string" else i
    return out


def test_every_case_column_by_name(spark):
    one = {t: distinct_row(t, 1000 * n) for n, t in enumerate(("cases", "consultations", "users", "surveys"), 1)}
    for t in ("consultations", "surveys"):
        one[t]["caseno"] = one["cases"]["caseno"]
    one["users"]["adastra"] = one["consultations"]["cons_clinicians_name"]
    got = cases.case_detail(make_tables(spark, **{t: [r] for t, r in one.items()})).collect()
    assert len(got) == 1
    sources = CASE_SOURCE | CONS_SOURCE | OTHER_SOURCE
    assert len(sources) == 52 and set(got[0].asDict()) == {*sources, "consultation_duration_mins"}
    for column, (table, name) in sources.items():
        assert got[0][column] == one[table][name], column
    span = one["consultations"]["cons_end_time"] - one["consultations"]["cons_begin_time"]
    assert got[0]["consultation_duration_mins"] == span.total_seconds() / 60


def test_numbers_of_repeated_rows(spark):
    """Case listed twice, two surveys, a clinician's name listed twice, cases without
    consultations: every row of the page has its number."""
    t = make_tables(
        spark,
        users=[dict(personid=1, adastra="a"), dict(personid=2, adastra="a"), dict(personid=3, adastra="b")],
        cases=[dict(caseno=1), dict(caseno=1), dict(caseno=2), dict(caseno=3), dict(caseno=None)],
        surveys=[dict(caseno=1, satisfaction=5), dict(caseno=1, satisfaction=4), dict(caseno=3, satisfaction=1), dict(caseno=3)],
        consultations=[
            dict(caseno=c, cons_clinicians_name=n, cons_begin_time=b, cons_end_time=b)
            for c, n, b in [
                (1, "a", T0), (1, "b", T0 + timedelta(minutes=5)), (1, "x", T0 + timedelta(hours=3)), (1, None, None),
                (2, "b", T0), (9, "a", T0), (None, "a", T0),
            ]
        ],
    )
    got = [r.asDict() for r in cases.case_consultations(t).collect()]
    assert len(got) == cases.case_detail(t).count()
    for key in (1, 2, 3, None):
        own = sorted((r["consultation_no"], r["cons_begin_time"] is None, r["cons_begin_time"] or T0) for r in got if r["caseno"] == key)
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert rows(cases.case_consultations(t, 1)) == sorted((tuple(r[c] for c in sorted(r)) for r in got if r["caseno"] == 1), key=str)


def test_catalog_tables_bucketed_on_the_join_key(spark, small_tables):
    write_bucketed(small_tables, "care_ops", buckets=4)
    try:
        t = Tables.from_catalog(spark, "care_ops")
        for name, df in small_tables.as_dict().items():
            assert rows(t.as_dict()[name]) == rows(df), name
        s, e = datetime(2024, 1, 2), datetime(2024, 1, 9)
        assert rows(hourly.calls_by_hour(t, s, e)) == rows(hourly.calls_by_hour(small_tables, s, e))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = t.consultations.join(t.rotas, "rslid")
        assert "Exchange" not in plan_text(joined) and joined.count() == small_tables.consultations.count()
        assert rows(clinicians.clinician_month(t, s)) == rows(clinicians.clinician_month(small_tables, s))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE care_ops CASCADE")
