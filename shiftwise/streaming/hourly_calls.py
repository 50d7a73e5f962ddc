"""Hourly call statistics as a Structured Streaming query.

The same per-hour numbers as ``plans.hourly.call_stats_hourly`` (calls,
total and inbound talk minutes), kept up to date as calls arrive: tumbling
1-hour event-time windows, a watermark bounding how late a call may be and
how long an hour's state is kept, and append output once an hour closes.

Watermarks need a zoned TIMESTAMP, so the NTZ call time is turned into the
instant with the same wall clock in UTC (through epoch microseconds, no
session time zone involved); windows are then whole wall-clock hours, and
the window start is turned back into NTZ the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwise import config, schemas
from shiftwise.functions.exprs import micros_between, ntz_lit, seconds_to_minutes2, to_double

EPOCH = "1970-01-01"


def ntz_to_instant(c) -> F.Column:
    return F.timestamp_micros(micros_between(ntz_lit(EPOCH), c))


def instant_to_ntz(c) -> F.Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), ntz_lit(EPOCH))


def read_calls_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 64) -> DataFrame:
    """Stream the phone_calls Parquet files arriving under ``path``."""
    return (
        spark.readStream.schema(schemas.PHONE_CALLS)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(path)
    )


def hourly_call_stats_stream(calls: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Per closed hour: hour_start, num_calls, total_minutes, total_inbound_minutes."""
    inbound = F.when(F.col("direction") == config.INBOUND, F.col("duration_talk")).otherwise(F.lit(0))
    windowed = (
        calls.withColumn("event_time", ntz_to_instant(F.col("start_time")))
        .withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", "1 hour"))
        .agg(
            F.count(F.lit(1)).alias("num_calls"),
            F.sum("duration_talk").alias("talk_seconds"),
            F.sum(inbound).alias("inbound_seconds"),
        )
    )
    return windowed.select(
        instant_to_ntz(F.col("window.start")).alias("hour_start"),
        "num_calls",
        to_double(seconds_to_minutes2(F.col("talk_seconds"))).alias("total_minutes"),
        to_double(seconds_to_minutes2(F.col("inbound_seconds"))).alias("total_inbound_minutes"),
    )
