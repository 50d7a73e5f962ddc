"""Materialised snapshots of the operational tables (the reference keeps
query results for an hour; here the inputs are laid out once for fast,
repeatable reads).

Two layouts:

* ``write_clustered`` — Parquet folders, each table range-partitioned and
  sorted on the column its reports filter by (login, begin, call start,
  case number), so Parquet row-group statistics skip most files for a month
  or hour range. Read back with ``Tables.from_parquet``.
* ``write_bucketed`` — catalog tables bucketed on the join keys: rotas and
  consultations by ``rslid`` (the largest join of the clinician reports
  then needs no shuffle), cases and surveys by ``caseno``. Read back with
  ``Tables.from_catalog``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shiftwise.sources.tables import Tables

# column whose ranges the reports filter on, per table
CLUSTER_BY = {
    "users": "personid",
    "rotas": "truelogin",
    "consultations": "cons_begin_time",
    "cases": "caseno",
    "surveys": "caseno",
    "phone_calls": "start_time",
}

BUCKET_BY = {
    "rotas": "rslid",
    "consultations": "rslid",
    "cases": "caseno",
    "surveys": "caseno",
}


def _clustered(df: DataFrame, column: str, files: int) -> DataFrame:
    return df.repartitionByRange(files, column).sortWithinPartitions(column)


def write_clustered(tables: Tables, root: str, files: int = 64, mode: str = "overwrite") -> None:
    """Write ``<root>/<table>`` Parquet folders clustered by ``CLUSTER_BY``."""
    for name, df in tables.as_dict().items():
        _clustered(df, CLUSTER_BY[name], files).write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def write_bucketed(tables: Tables, database: str, buckets: int = 256, mode: str = "overwrite") -> None:
    """Save the tables in ``database``, bucketed and sorted on the join keys."""
    spark = tables.rotas.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in tables.as_dict().items():
        writer = df.write.mode(mode).format("parquet")
        key = BUCKET_BY.get(name)
        if key:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{database}.{name}")
