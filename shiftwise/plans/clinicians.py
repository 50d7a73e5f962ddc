"""Monthly clinician performance: shift totals, consultation statistics,
the all-clinician month table and the per-shift table of one clinician.

A shift belongs to the month of its login; its consultations follow it
whatever their own dates. Only shifts with both login and logout count.
Keyed reports take ``personid=None`` for all clinicians at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftwise import config
from shiftwise.functions.exprs import (
    MONEY,
    ROUNDED,
    WHOLE,
    div_round2,
    in_month,
    micros_between,
    money,
    month_bounds,
    pct2,
    to_double,
)
from shiftwise.operators.consult_stats import MICROS, consultation_stats
from shiftwise.operators.numbering import number_by_range
from shiftwise.sources.tables import LOGIN_MONTH, MIXED_MONTH, Tables

HOURS = "decimal(14,6)"  # durationdecimal as an exact operand


def _month_key(month) -> str:
    first, _ = month_bounds(month)
    return f"{first.year:04d}-{first.month:02d}"


def month_shifts(t: Tables, month, personid: int | None = None) -> DataFrame:
    """Shifts logged in during ``month`` with login and logout recorded.

    The month test is a half-open range on ``truelogin`` so it reaches the
    Parquet scan (a truncate-and-compare would not).
    """
    r = t.rotas.filter(
        in_month("truelogin", month) & F.col("truelogin").isNotNull() & F.col("truelogout").isNotNull()
    )
    if LOGIN_MONTH in r.columns:  # a layout by months: other folders are not read
        r = r.filter(F.col(LOGIN_MONTH) == _month_key(month))
    if personid is not None:
        r = r.filter(F.col("personid") == F.lit(personid).cast("long"))
    return r


def _counted_consultations(t: Tables, month) -> DataFrame:
    """Consultations of the counted types that can belong to a shift of ``month``
    (of all months where the layout does not tell)."""
    cons = t.consultations
    if LOGIN_MONTH in cons.columns:
        cons = cons.filter(F.col(LOGIN_MONTH).isin(_month_key(month), MIXED_MONTH))
    return cons.filter(F.col("cons_type").isin(*config.COUNTED_TYPES)).select(
        "rslid",
        "caseno",
        "cons_type",
        "next_cons_type",
        micros_between("cons_begin_time", "cons_end_time").alias(MICROS),
    )


def _named_users(t: Tables) -> DataFrame:
    return t.users.filter(F.col("fullname").isNotNull()).select("personid", F.col("fullname").alias("clinician_name"))


# --- shift totals per clinician ------------------------------------------------


def _shift_totals(t: Tables, month) -> DataFrame:
    """Per (clinician_name, personid): shifts, hours, cost (DECIMAL).

    Rotas are reduced to one row per person before meeting ``users``; the
    second aggregate only folds persons listed twice under one name.
    """
    per_person = month_shifts(t, month).groupBy("personid").agg(
        F.countDistinct("rslid").alias("total_shifts"),
        F.sum("durationdecimal").alias("hours_sum"),
        F.sum(money("value")).alias("cost_sum"),
    )
    named = per_person.join(_named_users(t), "personid")
    return named.groupBy("clinician_name", "personid").agg(
        F.max("total_shifts").alias("total_shifts"),
        F.round(F.sum("hours_sum").cast("decimal(30,10)"), 2).cast(ROUNDED).alias("total_hours"),
        F.round(F.sum("cost_sum"), 2).cast(ROUNDED).alias("total_cost"),
    )


def shift_hours_month(t: Tables, month) -> DataFrame:
    """Shifts, hours and cost per clinician (name, person) for ``month``."""
    return _shift_totals(t, month).select(
        "clinician_name",
        "personid",
        "total_shifts",
        to_double(F.col("total_hours")).alias("total_hours"),
        to_double(F.col("total_cost")).alias("total_cost"),
    )


def _unique_name_cost(persons: str, cost: str) -> F.Column:
    """The cost looked up by clinician name; a name shared by two persons
    fails the job, as the scalar lookup of the cost by name does."""
    return (
        F.when(
            F.col(persons) > 1,
            F.raise_error(F.concat(F.lit("more than one person is named "), F.col("clinician_name"))),
        )
        .otherwise(F.col(cost))
        .cast(ROUNDED)
    )


def _cost_by_name(shift_totals: DataFrame) -> DataFrame:
    """Persons and a total cost per clinician name (for ``_unique_name_cost``)."""
    return shift_totals.groupBy("clinician_name").agg(
        F.count(F.lit(1)).alias("_persons"), F.first("total_cost").alias("_cost")
    )


# --- consultation statistics -----------------------------------------------------


def _consultation_stats_by_name(t: Tables, month) -> DataFrame:
    shifts = month_shifts(t, month).select("rslid", "personid").join(_named_users(t), "personid")
    rows = _counted_consultations(t, month).join(shifts.select("rslid", "clinician_name"), "rslid")
    return consultation_stats(rows, ["clinician_name"])


def _stats_columns(prefix: str = "") -> list:
    """Shared output of the statistics (names of the month table)."""
    return [
        F.col("advice_count").alias(f"{prefix}gp_advice_count"),
        F.col("treatment_centre_count").alias(f"{prefix}treatment_centre_count"),
        F.col("visit_count").alias(f"{prefix}visit_count"),
    ]


def consultation_stats_month(t: Tables, month) -> DataFrame:
    """Consultation statistics per clinician name for ``month``."""
    stats = _consultation_stats_by_name(t, month)
    cost = _cost_by_name(_shift_totals(t, month))
    # the names are checked after the join: only those in the statistics matter
    j = stats.join(cost, "clinician_name", "left").withColumn("name_total_cost", _unique_name_cost("_persons", "_cost"))
    return j.select(
        "clinician_name",
        F.col("n_cases").alias("total_consultations"),
        to_double(F.col("consultation_hours")).alias("total_consultation_hours"),
        to_double(div_round2(F.col("name_total_cost"), F.col("n_cases"), num_type=ROUNDED)).alias(
            "avg_consultation_cost"
        ),
        *_stats_columns(),
        F.col("same_advice_count").alias("same_advice_type_count"),
        F.col("advice_count").alias("total_advice_count"),
        to_double(F.col("avg_advice_triage_mins")).alias("avg_gp_advice_duration"),
        to_double(F.col("avg_treatment_centre_mins")).alias("avg_treatment_centre_duration"),
        to_double(F.col("avg_visit_mins")).alias("avg_visit_duration"),
    )


def _busiest_first(collation: str) -> list:
    return [F.col("total_shifts").desc(), F.collate("clinician_name", collation).asc_nulls_last()]


def clinician_ranking(t: Tables, month, collation: str = config.NAME_COLLATION) -> DataFrame:
    """Place of each clinician in the table of ``month``: most shifts first, then by
    name in ``collation``. Numbered by ranges, so no task sorts all names."""
    totals = _shift_totals(t, month).select("clinician_name", "personid", "total_shifts")
    order = [*_busiest_first(collation), F.col("clinician_name").asc_nulls_last(), F.col("personid").asc_nulls_last()]
    return number_by_range(totals, order, out="place")


def clinician_month(t: Tables, month, collation: str = config.NAME_COLLATION) -> DataFrame:
    """The all-clinician table of ``month``: shift totals joined with
    consultation statistics by clinician name, busiest first, then by name in ``collation``."""
    # persons per name over the shift totals (one row per person, so the
    # window groups are tiny) replaces a second aggregate and join
    sh = _shift_totals(t, month).withColumn(
        "_persons", F.count(F.lit(1)).over(Window.partitionBy("clinician_name"))
    )
    cs = _consultation_stats_by_name(t, month)
    j = sh.join(cs, "clinician_name").withColumn(
        "name_total_cost", _unique_name_cost("_persons", "total_cost")
    )
    return j.orderBy(*_busiest_first(collation)).select(
        "personid",
        "clinician_name",
        to_double(F.col("total_cost")).alias("total_cost"),
        "total_shifts",
        to_double(F.col("total_hours")).alias("total_hours"),
        to_double(F.col("consultation_hours")).alias("total_consultation_hours"),
        to_double(pct2(F.col("consultation_hours"), F.col("total_hours"))).alias("consultation_time_percentage"),
        F.col("n_cases").alias("total_consultations"),
        to_double(div_round2(F.col("name_total_cost"), F.col("n_cases"), num_type=ROUNDED)).alias(
            "avg_consultation_cost"
        ),
        *_stats_columns(),
        to_double(pct2(F.col("same_advice_count"), F.col("advice_count"), WHOLE, WHOLE)).alias(
            "advice_closed_percentage"
        ),
        to_double(F.col("avg_advice_triage_mins")).alias("avg_gp_advice_mins"),
        to_double(F.col("avg_treatment_centre_mins")).alias("avg_treatment_centre_mins"),
        to_double(F.col("avg_visit_mins")).alias("avg_visit_mins"),
    )


# --- per shift ---------------------------------------------------------------------


def _shift_stats(t: Tables, month, personid: int | None = None) -> DataFrame:
    shifts = month_shifts(t, month, personid).select("rslid")
    rows = _counted_consultations(t, month).join(shifts, "rslid")
    return consultation_stats(rows, ["rslid"], joined_on="rslid")


def shift_consultation_stats(t: Tables, month, personid: int | None = None) -> DataFrame:
    """Consultation statistics per shift of ``month`` (one clinician or all)."""
    s = _shift_stats(t, month, personid)
    return s.select(
        "rslid",
        F.col("n_cases").alias("shift_consultations"),
        to_double(F.col("consultation_hours")).alias("shift_consultation_hours"),
        *_stats_columns("shift_"),
        F.col("same_advice_count").alias("same_advice_type_count"),
        F.col("advice_count").alias("total_advice_count"),
        to_double(F.col("avg_advice_triage_mins")).alias("shift_avg_gp_advice_duration"),
        to_double(F.col("avg_treatment_centre_mins")).alias("shift_avg_treatment_centre_duration"),
        to_double(F.col("avg_visit_mins")).alias("shift_avg_visit_duration"),
    )


def _clinician_shift_rows(t: Tables, month, personid: int | None = None) -> DataFrame:
    """Shifts of the month that have a counted consultation, with their
    statistics and the clinician. ``rota_personid`` is the shift's person.

    "Has a counted consultation" (an EXISTS in the reference) holds exactly
    for the shifts present in the per-shift statistics, which are computed
    from the same shifts; so one inner join replaces semi join + outer join.
    """
    r = month_shifts(t, month, personid)
    stats = _shift_stats(t, month, personid)
    users = t.users.select(F.col("personid").alias("user_personid"), F.col("fullname"))
    rows = r.join(stats, "rslid").join(users, F.col("personid") == F.col("user_personid"), "left")
    cost = money("value")
    return rows.select(
        F.col("fullname").alias("clinician_name"),
        F.col("user_personid").alias("personid"),
        F.col("personid").alias("rota_personid"),
        "rslid",
        F.to_date("date").alias("shift_date"),
        F.col("truelogin").alias("shift_start"),
        F.col("truelogout").alias("shift_end"),
        cost.alias("shift_cost"),
        F.col("durationdecimal").alias("shift_hours"),
        F.col("consultation_hours").alias("shift_consultation_hours"),
        pct2(F.col("consultation_hours"), F.col("durationdecimal"), whole_type=HOURS).alias(
            "consultation_time_percentage"
        ),
        F.col("n_cases").alias("total_consultations"),
        div_round2(cost, F.col("n_cases"), num_type=MONEY).alias("cost_per_consultation"),
        *_stats_columns("shift_"),
        pct2(F.col("same_advice_count"), F.col("advice_count"), WHOLE, WHOLE).alias("advice_closed_percentage"),
        F.col("avg_advice_triage_mins").alias("avg_gp_advice_mins"),
        F.col("avg_treatment_centre_mins").alias("avg_treatment_centre_mins"),
        F.col("avg_visit_mins").alias("avg_visit_mins"),
        F.col("role").alias("shift_role"),
        F.col("dutystation").alias("location"),
        F.col("status").alias("shift_status"),
        F.col("date").alias("_date"),
    )


_DECIMAL_OUT = (
    "shift_cost",
    "shift_consultation_hours",
    "consultation_time_percentage",
    "cost_per_consultation",
    "advice_closed_percentage",
    "avg_gp_advice_mins",
    "avg_treatment_centre_mins",
    "avg_visit_mins",
)


def clinician_shifts(t: Tables, month, personid: int | None = None) -> DataFrame:
    """Per-shift table of one clinician (or all) for ``month``.

    For one clinician the rows are ordered by date and login; for all
    clinicians no global order is imposed.
    """
    rows = _clinician_shift_rows(t, month, personid)
    if personid is not None:
        rows = rows.orderBy(F.col("_date").asc_nulls_last(), F.col("shift_start").asc_nulls_last())
    cols = [c for c in rows.columns if c not in ("rota_personid", "_date")]
    return rows.select(*[to_double(F.col(c)).alias(c) if c in _DECIMAL_OUT else F.col(c) for c in cols])


def clinician_kpis(t: Tables, month, personid: int | None = None) -> DataFrame:
    """Summary of a clinician's month: consultations, hours and cost.

    A missing sum is 0; a clinician without shifts has no row.
    """
    rows = _clinician_shift_rows(t, month, personid)
    return rows.groupBy(F.col("rota_personid").alias("personid"), "clinician_name").agg(
        F.coalesce(F.sum("total_consultations"), F.lit(0)).cast("long").alias("total_consultations"),
        F.coalesce(F.sum("shift_hours"), F.lit(0.0)).alias("total_hours"),
        to_double(F.coalesce(F.sum("shift_cost"), F.lit(0).cast(MONEY))).alias("total_cost"),
    )


def shift_cost_by_date(t: Tables, month, personid: int | None = None) -> DataFrame:
    """Shift cost per date of a clinician's month (the cost bar chart)."""
    rows = _clinician_shift_rows(t, month, personid)
    return rows.groupBy(F.col("rota_personid").alias("personid"), "shift_date").agg(
        to_double(F.sum("shift_cost")).alias("total_shift_cost")
    )


def shift_location_counts(t: Tables, month, personid: int | None = None) -> DataFrame:
    """Number of a clinician's shifts per duty station (the location pie)."""
    rows = _clinician_shift_rows(t, month, personid).filter(F.col("location").isNotNull())
    return rows.groupBy(F.col("rota_personid").alias("personid"), "location").agg(
        F.count(F.lit(1)).alias("shift_count")
    )
