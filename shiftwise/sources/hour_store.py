"""Hourly partial aggregates that any range of hours can be put together from.

Three tables of partials, one row an hour and (for people) a bucket of 32,768 ids:

* ``calls``: number of calls, talk and inbound seconds, and a bitmap of agents;
* ``staff``: a bitmap of the call handlers on shift;
* ``types``: consultations by counted label.

Sums and bitmaps are exact and mergeable, so a report over any hours, or distinct
people over any longer period, comes from stored partials without the raw tables. Days
are the unit of storage: ``fill`` computes the days of a range that are not
stored yet in one pass over the raw tables (the range reaches their scans) and
publishes them by a manifest. Two writers may both store a day; readers
take it from one of them only.
"""

from __future__ import annotations

import time
import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwise import config
from shiftwise.functions.exprs import as_datetime, hour_count, hour_floor, in_range, ntz_lit, seconds_to_minutes2, to_double
from shiftwise.operators.hour_bins import HOUR_INDEX, HOUR_START, explode_hour_bins, hour_grid
from shiftwise.plans import hourly
from shiftwise.sources import manifests
from shiftwise.sources.tables import Tables

DAY = timedelta(days=1)

# columns of the stored partials; the day is the folder
_TYPES = ", ".join(f"{name} long" for name, _ in config.HOURLY_TYPE_COLUMNS)
SCHEMAS = {
    "calls": f"{HOUR_START} timestamp_ntz, bucket long, n_calls long, talk_seconds long, inbound_seconds long, people binary, day date",
    "staff": f"{HOUR_START} timestamp_ntz, bucket long, people binary, day date",
    "types": f"{HOUR_START} timestamp_ntz, {_TYPES}, day date",
}


def _people(person: str) -> tuple[Column, Column]:
    """Bucket of a person's id, and the bitmap of those in it (missing ids in neither)."""
    return F.bitmap_bucket_number(person).alias("bucket"), F.bitmap_construct_agg(F.bitmap_bit_position(person)).alias("people")


def _distinct() -> Column:
    """People in hours' bitmaps, one row a bucket: exact."""
    return F.coalesce(F.sum(F.bitmap_count("people")), F.lit(0))


def call_partials(t: Tables, start, end) -> DataFrame:
    bucket, people = _people("agent_number")
    inbound = F.when(F.col("direction") == config.INBOUND, F.col("duration_talk")).otherwise(F.lit(0))
    return t.phone_calls.filter(in_range("start_time", start, end)).groupBy(hour_floor("start_time").alias(HOUR_START), bucket).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum("duration_talk").cast("long").alias("talk_seconds"),
        F.sum(inbound).cast("long").alias("inbound_seconds"),
        people,
    )


def staff_partials(t: Tables, start, end) -> DataFrame:
    """Call handlers on shift in the hours from ``start`` to before ``end``."""
    bucket, people = _people("personid")
    last = as_datetime(end) - timedelta(hours=1)
    handlers = t.rotas.filter((F.col("role") == config.CALL_HANDLER_ROLE) & F.col("personid").isNotNull())
    bins = explode_hour_bins(handlers.select("personid", "truelogin", "truelogout"), "truelogin", "truelogout", start, last)
    hour = ntz_lit(start) + F.make_dt_interval(F.lit(0), F.col(HOUR_INDEX).cast("int"))
    return bins.groupBy(hour.alias(HOUR_START), bucket).agg(people)


def type_partials(t: Tables, start, end) -> DataFrame:
    return hourly.consult_type_hourly(t, start, end)


_COMPUTE = {"calls": call_partials, "staff": staff_partials, "types": type_partials}


def _aligned(start, end) -> tuple[datetime, datetime]:
    s, e = as_datetime(start), as_datetime(end)
    if any(x != x.replace(minute=0, second=0, microsecond=0) for x in (s, e)):
        raise ValueError("stored hours begin on the hour")
    return s, e


class HourStore:
    """Partials of ``tables`` below ``root``, apart for each version of the tables."""

    def __init__(self, spark: SparkSession, root: str, tables: Tables, version: str | None = None) -> None:
        read = (tables.rotas, tables.consultations, tables.phone_calls)
        self.spark, self.tables = spark, tables
        self.root = f"{root.rstrip('/')}/{version or manifests.files_version(*read)}"

    def days(self) -> dict[date, str]:
        """Stored days and the folder of each (the first that was published)."""
        found: dict[date, str] = {}
        for m in manifests.published(self.spark, self.root):  # newest first, so older ones win
            found |= {date.fromisoformat(d): m["data"] for d in m["days"]}
        return found

    def fill(self, start, end) -> list[date]:
        """Stores the days that meet ``start`` .. ``end`` (its hour included) and are
        not stored yet; which those were. ``end`` before ``start``: none."""
        s, e = _aligned(start, end)
        have = self.days()
        wanted = [s.date() + i * DAY for i in range((e.date() - s.date()).days + 1)] if e >= s else []
        missing = [d for d in wanted if d not in have]
        if not missing:
            return []
        data = f"data-{uuid.uuid4().hex}"
        begin, stop = as_datetime(missing[0]), as_datetime(missing[-1]) + DAY
        for kind, compute in _COMPUTE.items():
            rows = compute(self.tables, begin, stop).withColumn("day", F.to_date(HOUR_START))
            if len(missing) < (stop - begin).days:  # days between are stored already
                rows = rows.filter(F.col("day").isin(*missing))
            rows.write.partitionBy("day").parquet(f"{self.root}/{data}/{kind}")
        manifests.publish(
            self.spark, self.root, {"created": time.time(), "data": data, "days": [d.isoformat() for d in missing]}
        )
        return missing

    def partials(self, kind: str, start, end) -> DataFrame:
        """Stored partials of the hours from ``start`` to before ``end``; an error
        where a day is not stored."""
        s, e = _aligned(start, end)
        have, last = self.days(), (e - timedelta(microseconds=1)).date()
        days = [s.date() + i * DAY for i in range((last - s.date()).days + 1)] if e > s else []
        if lacking := [d for d in days if d not in have]:
            raise LookupError(f"{len(lacking)} days are not stored, the first is {lacking[0]}")
        out = self.spark.createDataFrame([], SCHEMAS[kind])
        for data in sorted({have[d] for d in days}):
            own = [d for d in days if have[d] == data]
            rows = self.spark.read.schema(SCHEMAS[kind]).parquet(f"{self.root}/{data}/{kind}")
            out = out.unionByName(rows.filter(F.col("day").isin(*own)))
        return out.filter(in_range(HOUR_START, s, e))

    # --- reports of stored hours -------------------------------------------------

    def _calls(self, start, end) -> DataFrame:
        return self.partials("calls", start, end).groupBy(HOUR_START).agg(
            F.sum("n_calls").alias("num_calls"),
            seconds_to_minutes2(F.sum("talk_seconds")).alias("total_minutes"),
            seconds_to_minutes2(F.sum("inbound_seconds")).alias("total_inbound_minutes"),
            _distinct().alias("agents"),
        )

    def call_stats_hourly(self, start, end) -> DataFrame:
        """``hourly.call_stats_hourly`` from stored hours."""
        return self._calls(start, end).select(
            HOUR_START, "num_calls", *[to_double(F.col(c)).alias(c) for c in ("total_minutes", "total_inbound_minutes")]
        )

    def calls_by_hour(self, start, end) -> DataFrame:
        """``hourly.calls_by_hour`` from stored hours, distinct agents included."""
        named = self._calls(start, end).select(
            F.col(HOUR_START).alias("call_hour"), F.col("num_calls").alias("calls_per_hour"), F.col("agents").alias("handlers_per_hour")
        )
        return named.orderBy("call_hour")

    def _staff(self, start, end) -> DataFrame:
        stop = as_datetime(end) + timedelta(hours=1)  # the hour of ``end`` is part of the series
        index = (F.timestamp_diff("HOUR", ntz_lit(start), F.col(HOUR_START))).alias(HOUR_INDEX)
        return self.partials("staff", start, stop).groupBy(index).agg(_distinct().alias("num_staff"))

    def staff_per_hour(self, start, end) -> DataFrame:
        """``hourly.staff_per_hour`` from stored hours."""
        return hourly.staff_on_grid(hour_grid(self.spark, start, end), self._staff(start, end), hour_count(*_aligned(start, end)) + 2)

    def hourly_activity(self, start, end) -> DataFrame:
        """``hourly.hourly_activity`` from stored hours."""
        types = self.partials("types", start, end).drop("day")
        return hourly.activity_on_grid(self.spark, start, end, self._calls(start, end), self._staff(start, end), types)

    def people_by_period(self, kind: str, start, end, unit: str = "DAY") -> DataFrame:
        """Distinct agents (``calls``) or handlers on shift (``staff``) per day, week,
        month or other ``unit``: bitmaps of its hours put together."""
        period = F.date_trunc(unit, HOUR_START).cast("timestamp_ntz").alias("period")
        per_bucket = self.partials(kind, start, end).groupBy(period, "bucket").agg(F.bitmap_or_agg("people").alias("people"))
        return per_bucket.groupBy("period").agg(_distinct().alias("people"))
