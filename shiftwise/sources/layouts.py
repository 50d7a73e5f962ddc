"""A layout of the operational tables for month reports and point lookups.

* ``rotas`` and ``consultations`` lie in a folder for each login month of their
  shift (``login_month=2024-01``): a month report reads the folders of its month and
  no others, whatever the consultations' own dates. Consultations without a shift lie
  under ``none``; those of a shift id listed in two months under ``mixed``, which
  every month report reads too.
* Inside a month, rows are dealt by ranges of the shift id and sorted by it; cases
  and surveys by case number, users by person, calls by start. Row groups of
  narrow key ranges are skipped by their statistics.
* Keys that are not in that order (the case of a consultation, the person of a
  shift, the login name of a user) get Parquet Bloom filters, as do the keys in
  order across months: a lookup of one key reads the row groups that hold it
  and a share ``false_reads`` of the rest.

Ranges are sampled over (month, shift, case), so a month or a shift with a third of
all rows is spread over several files. ``Tables`` read back with ``read_layout`` carry
``login_month``; the month reports use it where it is there.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwise import schemas
from shiftwise.sources import manifests
from shiftwise.sources.tables import LOGIN_MONTH, MIXED_MONTH, NO_MONTH, Tables

#: table -> (range and sort columns, columns with a Bloom filter)
LAYOUT = {
    "users": (("personid",), ("personid", "adastra")),
    "rotas": ((LOGIN_MONTH, "rslid"), ("rslid", "personid")),
    "consultations": ((LOGIN_MONTH, "rslid", "caseno"), ("rslid", "caseno")),
    "cases": (("caseno",), ("caseno",)),
    "surveys": (("caseno",), ("caseno",)),
    "phone_calls": (("start_time",), ()),
}


def month_name(ts: Column | str) -> Column:
    """Folder of a login time: '2024-01', or the one of missing logins."""
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit(NO_MONTH))


def with_login_months(t: Tables) -> Tables:
    """``t`` whose rotas and consultations carry their shift's login month."""
    rotas = t.rotas.drop(LOGIN_MONTH).withColumn(LOGIN_MONTH, month_name("truelogin"))
    months = rotas.groupBy(F.col("rslid").alias("_shift")).agg(F.min(LOGIN_MONTH).alias("_a"), F.max(LOGIN_MONTH).alias("_z"))
    cons = t.consultations.drop(LOGIN_MONTH)
    own = F.when(F.col("_a").isNull(), F.lit(NO_MONTH)).when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise(F.lit(MIXED_MONTH))
    cons = cons.join(months, cons["rslid"] == F.col("_shift"), "left").select(*cons.columns, own.alias(LOGIN_MONTH))
    return t.with_tables(rotas=rotas, consultations=cons)


def write_layout(
    tables: Tables,
    root: str,
    files: int | None = None,
    keys_a_group: int = 1 << 20,
    false_reads: float = 0.01,
    row_group_bytes: int = 128 << 20,
    mode: str = "errorifexists",
) -> None:
    """Write ``<root>/<table>``. ``files`` ranges a table (default: Spark's choice by
    size), ``keys_a_group`` distinct keys expected in a row group."""
    for name, df in with_login_months(tables).as_dict().items():
        order, filtered = LAYOUT[name]
        ranges = [F.col(c).asc_nulls_first() for c in order]
        dealt = df.repartitionByRange(*([files] if files else []), *ranges).sortWithinPartitions(*ranges)
        writer = dealt.write.mode(mode).option("parquet.block.size", row_group_bytes)
        for c in filtered:
            writer = (
                writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
                .option(f"parquet.bloom.filter.expected.ndv#{c}", keys_a_group)
                .option(f"parquet.bloom.filter.fpp#{c}", false_reads)
            )
        if LOGIN_MONTH in df.columns:
            writer = writer.partitionBy(LOGIN_MONTH)
        writer.parquet(f"{root.rstrip('/')}/{name}")


def read_layout(spark: SparkSession, root: str) -> Tables:
    """Tables written by ``write_layout``."""

    def read(name: str) -> DataFrame:
        fields = schemas.ALL[name].simpleString()[len("struct<") : -1]
        month = LOGIN_MONTH in LAYOUT[name][0]
        schema = ", ".join(f.replace(":", " ", 1) for f in fields.split(",")) + f", {LOGIN_MONTH} string" * month
        return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")

    return Tables.from_frames(**{name: read(name) for name in LAYOUT})


def laid_out(tables: Tables, root: str, version: str | None = None, **options) -> Tables:
    """The layout of ``tables`` below ``root``, written where there is none yet of
    this ``version`` of theirs (by default that of their files)."""
    spark = tables.rotas.sparkSession
    folder = f"{root.rstrip('/')}/{version or manifests.files_version(*tables.as_dict().values())}"
    found = manifests.published(spark, folder)
    if not found:
        data = f"data-{uuid.uuid4().hex}"
        write_layout(tables, f"{folder}/{data}", **options)
        manifests.publish(spark, folder, {"created": time.time(), "data": data})
        found = manifests.published(spark, folder)
    return read_layout(spark, f"{folder}/{found[-1]['data']}")
