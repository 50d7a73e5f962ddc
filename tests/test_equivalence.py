"""Rewrites used for scale give the same rows as the direct formulation."""

from datetime import datetime

from pyspark.sql import functions as F

from shiftwise import config
from shiftwise.functions.exprs import div_round2, hours2, micros_between, MICROS_PER_MINUTE
from shiftwise.operators.consult_stats import MICROS, consultation_stats
from shiftwise.plans import clinicians as C
from shiftwise.plans import rosters


def _rows(t):
    shifts = C.month_shifts(t, datetime(2024, 1, 1)).select("rslid")
    cons = t.consultations.filter(F.col("cons_type").isin(*config.COUNTED_TYPES)).select(
        "rslid", "caseno", "cons_type", "next_cons_type",
        micros_between("cons_begin_time", "cons_end_time").alias(MICROS),
    )
    return cons.join(shifts, "rslid")


def test_two_phase_equals_count_distinct(small_tables):
    rows = _rows(small_tables)
    got = consultation_stats(rows, ["rslid"])
    a = F.col("cons_type").isin(*config.ADVICE_TYPES)

    def when_case(cond):
        return F.countDistinct(F.when(cond, F.col("caseno")))

    def avg(types):
        cond = F.col("cons_type").isin(*types)
        return div_round2(
            F.sum(F.when(cond, F.col(MICROS))), F.count(F.when(cond, F.col(MICROS))) * F.lit(MICROS_PER_MINUTE)
        )

    want = rows.groupBy("rslid").agg(
        F.countDistinct("caseno").alias("n_cases"),
        hours2(F.sum(MICROS)).alias("consultation_hours"),
        when_case(a).alias("advice_count"),
        when_case(F.col("cons_type").isin(*config.TREATMENT_CENTRE_TYPES)).alias("treatment_centre_count"),
        when_case(F.col("cons_type").isin(*config.VISIT_TYPES)).alias("visit_count"),
        when_case(a & F.col("next_cons_type").isin(*config.ADVICE_TYPES)).alias("same_advice_count"),
        avg(config.ADVICE_OR_TRIAGE_TYPES).alias("avg_advice_triage_mins"),
        avg(config.TREATMENT_CENTRE_TYPES).alias("avg_treatment_centre_mins"),
        avg(config.VISIT_TYPES).alias("avg_visit_mins"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_semi_join_equals_inner_join_distinct(small_tables):
    t = small_tables
    got = rosters.clinicians(t)
    want = (
        t.users.join(t.consultations, t.users["adastra"] == t.consultations["cons_clinicians_name"])
        .select(t.users["personid"], t.users["fullname"], t.users["adastra"])
        .distinct()
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_inner_join_with_stats_equals_exists(small_tables):
    t = small_tables
    month = datetime(2024, 1, 1)
    got = C.clinician_shifts(t, month).select("rslid")
    counted = t.consultations.filter(F.col("cons_type").isin(*config.COUNTED_TYPES))
    want = C.month_shifts(t, month).join(counted, "rslid", "left_semi").select("rslid")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.collect())
