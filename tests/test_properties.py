"""Invariants of the reports on the small fixture, and single-key = all-keys."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shiftwise.functions.exprs import default_range, resolve_month
from shiftwise.plans import cases, clinicians, hourly

START, END = datetime(2024, 1, 2), datetime(2024, 1, 9)
MONTH = datetime(2024, 1, 1)


def test_hourly_calls_sum_to_calls_in_range(small_tables):
    total = hourly.hourly_activity(small_tables, START, END).agg(F.sum("num_calls")).first()[0]
    calls = small_tables.phone_calls.filter((F.col("start_time") >= START) & (F.col("start_time") < END)).count()
    assert total == calls


def test_staff_at_most_distinct_handlers(small_tables):
    most = hourly.staff_per_hour(small_tables, START, END).agg(F.max("num_staff")).first()[0]
    handlers = (
        small_tables.rotas.filter(F.col("role") == "Call Handler").select("personid").distinct().count()
    )
    assert 0 < most <= handlers


def test_conditional_counts_at_most_total(small_tables):
    rows = clinicians.clinician_month(small_tables, MONTH).collect()
    assert rows
    for r in rows:
        assert r["gp_advice_count"] <= r["total_consultations"]
        assert r["treatment_centre_count"] <= r["total_consultations"]
        assert r["visit_count"] <= r["total_consultations"]
        pct = r["advice_closed_percentage"]
        assert pct is None or 0 <= pct <= 100


def test_month_table_is_ordered(small_tables):
    rows = clinicians.clinician_month(small_tables, MONTH).collect()
    keys = [(-r["total_shifts"], r["clinician_name"]) for r in rows]
    assert keys == sorted(keys)


def _smallest_key(df, col):
    return df.agg(F.min(col)).first()[0]


def test_single_shift_equals_all_shifts_filtered(small_tables):
    rslid = _smallest_key(small_tables.consultations, "rslid")
    one = cases.shift_detail(small_tables, rslid).collect()
    allk = cases.shift_detail(small_tables).filter(F.col("rslid") == rslid).collect()
    assert sorted(one, key=str) == sorted(allk, key=str)
    begins = [r["consultation_start"] for r in one]
    assert begins == sorted(begins, key=lambda b: (b is None, b))


def test_single_case_equals_all_cases_filtered(small_tables):
    caseno = _smallest_key(small_tables.surveys.join(small_tables.consultations, "caseno", "left_semi"), "caseno")
    for fn in (cases.case_detail, cases.case_header, cases.case_consultations, cases.survey_feedback):
        one = fn(small_tables, caseno).collect()
        allk = fn(small_tables).filter(F.col("caseno") == caseno).collect()
        assert sorted(one, key=str) == sorted(allk, key=str), fn.__name__


def test_single_clinician_equals_all_filtered(small_tables):
    for fn in (clinicians.clinician_shifts, clinicians.clinician_kpis):
        one = fn(small_tables, MONTH, 0).collect()
        allk = fn(small_tables, MONTH).filter(F.col("personid") == 0).collect()
        assert one and sorted(one, key=str) == sorted(allk, key=str), fn.__name__


@pytest.mark.parametrize(
    "arg, want",
    [
        ("January 2024", datetime(2024, 1, 1)),
        ("2024-01-17", datetime(2024, 1, 1)),
        (date(2024, 3, 9), datetime(2024, 3, 1)),
        ("(All)", datetime(2024, 10, 1)),
        (None, datetime(2024, 10, 1)),
    ],
)
def test_resolve_month(arg, want):
    assert resolve_month(arg) == want


def test_default_range():
    assert default_range(date(2024, 1, 9)) == (datetime(2024, 1, 8), datetime(2024, 1, 9))
