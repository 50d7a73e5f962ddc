"""Hourly series and the interval-overlap join against it.

The reference semantics are a theta join of an hourly series with shifts
(``login + 1 min <= hour + 1 h AND logout + 1 min > hour``). Planned as is,
that is a nested-loop join. Here each shift is turned into the contiguous
range of series indices it overlaps, computed in closed form, and exploded;
the series is then an equi-join on the index. Work is linear in
Σ(hours per shift within the series) and the series size is bounded by the
arguments, not by the data.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwise.functions.exprs import (
    MICROS_PER_HOUR,
    MICROS_PER_MINUTE,
    as_datetime,
    ceil_div,
    hour_count,
    micros_between,
    ntz_lit,
)

HOUR_INDEX = "hour_index"
HOUR_START = "hour_start"


def hour_grid(spark: SparkSession, start, end) -> DataFrame:
    """Hourly series ``start, start + 1 h, ... <= end`` (end inclusive).

    Empty when ``end < start``. Columns: hour_index BIGINT, hour_start NTZ.
    Its size is fixed by the arguments (one row per hour of the range).
    """
    s, e = as_datetime(start), as_datetime(end)
    n = hour_count(s, e)
    return spark.range(0, n + 1, numPartitions=1).select(
        F.col("id").alias(HOUR_INDEX),
        (ntz_lit(s) + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias(HOUR_START),
    )


def overlap_prefilter(login: Column, logout: Column, start: datetime, end: datetime) -> Column:
    """Necessary condition on the raw columns (pushed to the scan)."""
    s, e = as_datetime(start), as_datetime(end)
    return (logout > ntz_lit(s) - F.expr("INTERVAL 1 MINUTE")) & (
        login <= ntz_lit(e) + F.expr("INTERVAL 59 MINUTES")
    )


def explode_hour_bins(df: DataFrame, login: str, logout: str, start, end) -> DataFrame:
    """One row per (input row, series index it touches), in ``hour_index``.

    Index ``i`` (hour ``h = start + i h``) is touched when
    ``login + 1 min <= h + 1 h`` and ``logout + 1 min > h``; rows with a
    null login or logout touch nothing.
    """
    s, e = as_datetime(start), as_datetime(end)
    n = hour_count(s, e)
    since_login = micros_between(ntz_lit(s), F.col(login)) + F.lit(MICROS_PER_MINUTE - MICROS_PER_HOUR)
    since_logout = micros_between(ntz_lit(s), F.col(logout)) + F.lit(MICROS_PER_MINUTE)
    lo = F.greatest(F.lit(0).cast("long"), ceil_div(since_login, MICROS_PER_HOUR))
    hi = F.least(F.lit(n).cast("long"), ceil_div(since_logout, MICROS_PER_HOUR) - 1)
    return (
        df.filter(F.col(login).isNotNull() & F.col(logout).isNotNull())
        .filter(overlap_prefilter(F.col(login), F.col(logout), s, e))
        .withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .filter(F.col("_lo") <= F.col("_hi"))
        .withColumn(HOUR_INDEX, F.explode(F.sequence(F.col("_lo"), F.col("_hi"))))
        .drop("_lo", "_hi")
    )
