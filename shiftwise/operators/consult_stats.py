"""Consultation statistics per key (clinician name, or shift).

Five ``COUNT(DISTINCT CASE WHEN .. THEN caseno END)`` plus sums and averages
over the same rows. Catalyst plans several distinct aggregates with an
``Expand`` (one copy of every row per distinct aggregate). Here the rows
are first reduced to one row per (key, case) carrying per-case flags and
partial sums, then to one row per key. Both phases are hash aggregates with
map-side partial aggregation, and the shuffle of phase one is on
(key, case), so one very busy clinician or shift is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwise import config
from shiftwise.functions.exprs import MICROS_PER_MINUTE, div_round2, hours2

MICROS = "_micros"


def _flag(cond: Column) -> Column:
    return F.max(F.when(cond, F.lit(1)).otherwise(F.lit(0)))


def _typed(types: tuple[str, ...]) -> Column:
    return F.col("cons_type").isin(*types)


def consultation_stats(rows: DataFrame, keys: list[str], joined_on: str | None = None) -> DataFrame:
    """``rows``: keys + caseno, cons_type, next_cons_type, _micros (end - begin).

    ``joined_on`` names a BIGINT key by which ``rows`` come dealt from a join. Phase
    one would take that dealing over, one task to a hot key; it groups by the key's
    complement instead, so it combines in the join's tasks, deals only combined rows by
    (key, case), and leaves the join free to split a hot key.

    Returns per key (DECIMAL where rounded):
    n_cases, consultation_hours, advice_count, treatment_centre_count,
    visit_count, same_advice_count, avg_advice_triage_mins,
    avg_treatment_centre_mins, avg_visit_mins.
    """
    advice = _typed(config.ADVICE_TYPES)
    stays_advice = advice & F.col("next_cons_type").isin(*config.ADVICE_TYPES)
    if joined_on:
        rows = rows.withColumn(joined_on, F.bitwise_not(joined_on))
    per_case = rows.groupBy(*keys, "caseno").agg(
        F.sum(MICROS).alias("micros"),
        _flag(advice).alias("is_advice"),
        _flag(_typed(config.TREATMENT_CENTRE_TYPES)).alias("is_tc"),
        _flag(_typed(config.VISIT_TYPES)).alias("is_visit"),
        _flag(stays_advice).alias("is_same_advice"),
        *[
            agg
            for name, types in (
                ("advice_triage", config.ADVICE_OR_TRIAGE_TYPES),
                ("tc", config.TREATMENT_CENTRE_TYPES),
                ("visit", config.VISIT_TYPES),
            )
            for agg in (
                F.sum(F.when(_typed(types), F.col(MICROS))).alias(f"{name}_micros"),
                F.count(F.when(_typed(types), F.col(MICROS))).alias(f"{name}_n"),
            )
        ],
    )
    if joined_on:
        per_case = per_case.withColumn(joined_on, F.bitwise_not(joined_on))
    case = F.col("caseno").isNotNull()

    def cases_with(flag: str) -> Column:
        return F.count_if(case & (F.col(flag) == 1))

    def avg_minutes(name: str) -> Column:
        return div_round2(
            F.sum(f"{name}_micros"), F.sum(f"{name}_n") * F.lit(MICROS_PER_MINUTE)
        )

    return per_case.groupBy(*keys).agg(
        F.count("caseno").alias("n_cases"),
        hours2(F.sum("micros")).alias("consultation_hours"),
        cases_with("is_advice").alias("advice_count"),
        cases_with("is_tc").alias("treatment_centre_count"),
        cases_with("is_visit").alias("visit_count"),
        cases_with("is_same_advice").alias("same_advice_count"),
        avg_minutes("advice_triage").alias("avg_advice_triage_mins"),
        avg_minutes("tc").alias("avg_treatment_centre_mins"),
        avg_minutes("visit").alias("avg_visit_mins"),
    )
