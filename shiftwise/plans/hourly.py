"""Hourly activity: calls, call handlers on shift and consultations per hour.

Arguments ``start`` / ``end`` are dates or naive datetimes. As in the
reference, the hourly series includes the ``end`` hour while calls and
consultations are counted only before ``end``, so the last row carries a
staff count and zeros elsewhere. A series not aligned to the hour never
meets the hour buckets of calls and consultations (zeros there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwise import config
from shiftwise.functions.exprs import (
    as_datetime,
    div_round2,
    hour_count,
    hour_floor,
    hour_label,
    in_range,
    seconds_to_minutes2,
    to_double,
    ROUNDED,
)
from shiftwise.operators.hour_bins import HOUR_INDEX, HOUR_START, explode_hour_bins, hour_grid
from shiftwise.operators.joins import bounded_broadcast
from shiftwise.sources.tables import Tables


def _session(t: Tables) -> SparkSession:
    return t.rotas.sparkSession


def _call_stats(t: Tables, start, end) -> DataFrame:
    """Per hour bucket: calls, and total / inbound talk minutes (DECIMAL)."""
    calls = t.phone_calls.filter(in_range("start_time", start, end))
    inbound = F.when(F.col("direction") == config.INBOUND, F.col("duration_talk")).otherwise(F.lit(0))
    return calls.groupBy(hour_floor("start_time").alias(HOUR_START)).agg(
        F.count(F.lit(1)).alias("num_calls"),
        seconds_to_minutes2(F.sum("duration_talk")).alias("total_minutes"),
        seconds_to_minutes2(F.sum(inbound)).alias("total_inbound_minutes"),
    )


def call_stats_hourly(t: Tables, start, end) -> DataFrame:
    """Calls per hour bucket in ``[start, end)``: count, total and inbound minutes."""
    return _call_stats(t, start, end).select(
        HOUR_START,
        "num_calls",
        to_double(F.col("total_minutes")).alias("total_minutes"),
        to_double(F.col("total_inbound_minutes")).alias("total_inbound_minutes"),
    )


def _staff_by_index(t: Tables, start, end) -> DataFrame:
    handlers = t.rotas.filter(F.col("role") == config.CALL_HANDLER_ROLE).select(
        "personid", "truelogin", "truelogout"
    )
    bins = explode_hour_bins(handlers, "truelogin", "truelogout", start, end)
    # countDistinct is planned as a partial aggregate on (hour, person)
    # first, so even a very busy hour is deduplicated map-side.
    return bins.groupBy(HOUR_INDEX).agg(F.countDistinct("personid").alias("num_staff"))


def staff_on_grid(grid: DataFrame, staff: DataFrame, bound: int) -> DataFrame:
    """Staff counts by hour index laid on the hours of ``grid`` (0 if none)."""
    return grid.join(bounded_broadcast(staff, bound), HOUR_INDEX, "left").select(
        HOUR_START, F.coalesce(F.col("num_staff"), F.lit(0)).cast("long").alias("num_staff")
    )


def _hour_bound(start, end) -> int:
    """Hour buckets met by the range."""
    return hour_count(as_datetime(start), as_datetime(end)) + 2


def staff_per_hour(t: Tables, start, end) -> DataFrame:
    """Distinct call handlers on shift for each hour of the series (0 if none)."""
    return staff_on_grid(hour_grid(_session(t), start, end), _staff_by_index(t, start, end), _hour_bound(start, end))


def _consult_types(t: Tables, start, end) -> DataFrame:
    cons = t.consultations.filter(in_range("cons_begin_time", start, end))
    return cons.groupBy(hour_floor("cons_begin_time").alias(HOUR_START)).agg(
        *[F.count_if(F.col("cons_type") == label).alias(name) for name, label in config.HOURLY_TYPE_COLUMNS]
    )


def consult_type_hourly(t: Tables, start, end) -> DataFrame:
    """Consultation rows per begin-hour bucket in ``[start, end)``, by single label."""
    return _consult_types(t, start, end)


def hourly_activity(t: Tables, start, end) -> DataFrame:
    """The hourly activity table: one row per hour of the series start..end.

    Three aggregates (calls, staff, consultations) are each reduced to at
    most one row per hour of the range before they meet the series. That
    bound is known from the arguments, so they are broadcast when it is
    small; the data volume only affects the scans and partial aggregates.
    """
    return activity_on_grid(
        _session(t), start, end, _call_stats(t, start, end), _staff_by_index(t, start, end), _consult_types(t, start, end)
    )


def activity_on_grid(
    spark: SparkSession, start, end, calls: DataFrame, staff: DataFrame, cons: DataFrame
) -> DataFrame:
    """The three hourly aggregates, each at most a row an hour, laid on the series."""
    grid = hour_grid(spark, as_datetime(start), as_datetime(end))
    calls, staff, cons = (bounded_broadcast(x, _hour_bound(start, end)) for x in (calls, staff, cons))
    joined = (
        grid.join(calls, HOUR_START, "left")
        .join(staff, HOUR_INDEX, "left")
        .join(cons, HOUR_START, "left")
    )
    num_staff = F.coalesce(F.col("num_staff"), F.lit(0)).cast("long")
    inbound = F.coalesce(F.col("total_inbound_minutes"), F.lit(0).cast(ROUNDED))
    per_handler = F.when(num_staff == 0, F.lit(0).cast(ROUNDED)).otherwise(
        div_round2(inbound, num_staff, num_type=ROUNDED)
    )
    zero = F.lit(0).cast("long")
    # ordering a result of the series' size (one row per hour) is cheap
    return joined.orderBy(HOUR_START).select(
        hour_label(HOUR_START).alias("hour"),
        F.coalesce(F.col("num_calls"), zero).alias("num_calls"),
        to_double(F.coalesce(F.col("total_minutes"), F.lit(0).cast(ROUNDED))).alias("total_minutes"),
        to_double(inbound).alias("total_inbound_minutes"),
        num_staff.alias("num_call_handlers"),
        to_double(per_handler).alias("inbound_minutes_per_handler"),
        *[F.coalesce(F.col(name), zero).alias(name) for name, _ in config.HOURLY_TYPE_COLUMNS],
    )


def hourly_activity_long(t: Tables, start, end) -> DataFrame:
    """The five charted series of the hourly table in long form (hour, metric, value)."""
    wide = hourly_activity(t, start, end)
    return wide.unpivot(["hour"], list(config.HOURLY_CHART_SERIES), "metric", "value")


def calls_by_hour(t: Tables, start, end) -> DataFrame:
    """Calls and distinct agents per hour bucket in ``[start, end)``."""
    calls = t.phone_calls.filter(in_range("start_time", start, end))
    return (
        calls.groupBy(hour_floor("start_time").alias("call_hour"))
        .agg(
            F.count(F.lit(1)).alias("calls_per_hour"),
            F.countDistinct("agent_number").alias("handlers_per_hour"),
        )
        .orderBy("call_hour")
    )
