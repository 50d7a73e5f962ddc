"""Rota tables joined with consulting clinicians, calendar labels, option
lists and the daily hours and cost by role."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shiftwise import config
from shiftwise.functions.exprs import (
    MONEY,
    duration_micros,
    in_month,
    micros_to_hours,
    money,
    month_label,
    normalise_duration,
    nullif_blank,
    ntz_lit,
    to_double,
)
from shiftwise.functions.coercion import observe_losses
from shiftwise.operators.numbering import number_by_range, number_within
from shiftwise import schemas
from shiftwise.sources.tables import Tables


def clinicians(t: Tables) -> DataFrame:
    """Distinct users who appear as the clinician of some consultation.

    The consultation side is reduced to its distinct clinician names
    (combined map-side) before the semi join, so a clinician with a huge
    share of consultations is a single row there.
    """
    names = t.consultations.select(F.col("cons_clinicians_name").alias("adastra")).distinct()
    return t.users.join(names, "adastra", "left_semi").select("personid", "fullname", "adastra").distinct()


def rotas_clinicians(t: Tables) -> DataFrame:
    """Every rota row of a consulting clinician, with name and login name.

    Person ids match when equal or both missing (the frame merge the
    reference uses pairs missing keys).
    """
    r = t.rotas
    u = clinicians(t)
    j = r.join(u, r["personid"].eqNullSafe(u["personid"]))
    return j.select(*[r[f.name] for f in schemas.ROTAS.fields], u["fullname"], u["adastra"])


def rotas_calendar(t: Tables) -> DataFrame:
    """``rotas_clinicians`` plus year, short month and 'Month YYYY' label of the rota date."""
    rc = rotas_clinicians(t)
    return rc.select(
        "*",
        F.year("date").alias("year"),
        F.date_format("date", "MMM").alias("month"),
        month_label("date").alias("month_year"),
    )


def month_filter(t: Tables, month) -> DataFrame:
    """Calendar rows whose label is ``month``'s (written as a date range,
    which is the same test and can be pushed to the scan)."""
    return rotas_calendar(t).filter(in_month("date", month))


def month_options(t: Tables) -> DataFrame:
    """Month choices: '(All)' first (index 0), then months newest first."""
    months = (
        rotas_clinicians(t)
        .filter(F.col("date").isNotNull())
        .select(F.make_timestamp_ntz(F.year("date"), F.month("date"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("m"))
        .distinct()
    )
    numbered = number_within(months, [], [F.col("m").desc()], [-F.year("m")], out="option_index")
    listed = numbered.select("option_index", month_label("m").alias("month_year"))
    head = t.rotas.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("option_index"), F.lit(config.ALL_OPTION).alias("month_year")
    )
    return head.unionByName(listed)


def adastra_options(t: Tables, collation: str | None = None) -> DataFrame:
    """Clinician login-name choices with '(All)', sorted as text (index from 0):
    by code point, or in ``collation``."""
    names = rotas_clinicians(t).select("adastra").filter(F.col("adastra").isNotNull()).distinct()
    head = t.rotas.sparkSession.range(1).select(F.lit(config.ALL_OPTION).alias("adastra"))
    options = head.unionByName(names)
    order = [F.collate("adastra", collation).asc()] if collation else []
    numbered = number_by_range(options, [*order, F.col("adastra").asc()], out="option_index")
    return numbered.select((F.col("option_index") - 1).alias("option_index"), "adastra")


def _with_losses(rows: DataFrame, losses: Observation | None) -> DataFrame:
    """Counts, where asked for, the durations and costs that are there but do not parse."""
    if losses is None:
        return rows
    micros = duration_micros(normalise_duration("duration"))
    coerced = {"duration": (F.col("duration"), micros), "value": (F.col("value"), nullif_blank("value"))}
    return observe_losses(rows, coerced, losses)


def duration_hours(t: Tables, losses: Observation | None = None) -> DataFrame:
    """Rota duration text normalised to H:MM:SS and converted to hours
    (null when it does not parse; ``losses`` counts these)."""
    rc = _with_losses(rotas_clinicians(t), losses)
    text = normalise_duration("duration")
    return rc.select(
        "rslid",
        "personid",
        text.alias("duration"),
        micros_to_hours(duration_micros(text)).alias("duration_hours"),
    )


def daily_role_hours_cost(t: Tables, start, end, losses: Observation | None = None) -> DataFrame:
    """Hours and cost per (rota date, role) for dates ``start <= date <= end``.

    Missing hours or costs are skipped (a group of only missing values sums
    to 0); rows without a date or role are left out. Hours are summed as
    exact microseconds and converted once. ``losses`` counts the values of these
    rows that are there but do not parse.
    """
    rc = rotas_clinicians(t).filter(
        (F.col("date") >= ntz_lit(start)) & (F.col("date") <= ntz_lit(end)) & F.col("role").isNotNull()
    )
    rc = _with_losses(rc, losses)
    micros = duration_micros(normalise_duration("duration"))
    return rc.groupBy("date", "role").agg(
        micros_to_hours(F.coalesce(F.sum(micros), F.lit(0))).alias("total_hours"),
        to_double(F.coalesce(F.sum(money("value")), F.lit(0).cast(MONEY))).alias("total_cost"),
    )


def coercion_losses(t: Tables, start, end) -> DataFrame:
    """Per column, the values that ``daily_role_hours_cost`` loses to coercion in the
    date range, counted while the report itself is computed."""
    losses = Observation("coercion")
    daily_role_hours_cost(t, start, end, losses).write.format("noop").mode("overwrite").save()
    return t.rotas.sparkSession.createDataFrame(sorted(losses.get.items()), "column_name string, n_lost long")
