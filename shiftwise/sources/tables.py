"""The bundle of operational tables every report reads."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructType, TimestampNTZType

from shiftwise import schemas

TABLE_NAMES = tuple(schemas.ALL)

#: Column of a layout by months: the login month of a row's shift.
LOGIN_MONTH = "login_month"
NO_MONTH = "none"  # no shift, or one without a login
MIXED_MONTH = "mixed"  # a shift id listed in several months


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: same names, order and types.

    Missing columns become typed nulls, and so do texts in a time column that
    are no time; extra columns are dropped (so column
    pruning still reaches the scan), but for the month of a layout by months.
    """
    present = {c.lower(): c for c in df.columns}
    cols = []
    for field in schema.fields:
        src = present.get(field.name.lower())
        value = F.col(src) if src else F.lit(None)
        # a time written as text that is none becomes missing, as a coerced date does
        dated = src and isinstance(df.schema[src].dataType, StringType) and isinstance(field.dataType, (DateType, TimestampNTZType))
        cast = value.try_cast if dated else value.cast
        cols.append(cast(field.dataType).alias(field.name))
    return df.select(*cols, *[LOGIN_MONTH for c in present if c == LOGIN_MONTH])


@dataclass(frozen=True)
class Tables:
    users: DataFrame
    rotas: DataFrame
    consultations: DataFrame
    cases: DataFrame
    surveys: DataFrame
    phone_calls: DataFrame

    # --- loaders -------------------------------------------------------------

    @classmethod
    def from_frames(cls, **frames: DataFrame) -> "Tables":
        return cls(**{name: conform(frames[name], schemas.ALL[name]) for name in TABLE_NAMES})

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, **paths: str) -> "Tables":
        """Read ``<root>/<table>`` Parquet folders with the fixed schemas."""
        frames = {}
        for name in TABLE_NAMES:
            path = paths.get(name, f"{root.rstrip('/')}/{name}")
            frames[name] = spark.read.schema(schemas.ALL[name]).parquet(path)
        return cls.from_frames(**frames)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str | None = None) -> "Tables":
        prefix = f"{database}." if database else ""
        return cls.from_frames(**{n: spark.table(prefix + n) for n in TABLE_NAMES})

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        properties: dict[str, str],
        partitioning: dict[str, dict[str, object]] | None = None,
        table_names: dict[str, str] | None = None,
    ) -> "Tables":
        """Read the tables over JDBC, each split into parallel range reads.

        ``partitioning[name]`` = ``{"column": ..., "lowerBound": ..,
        "upperBound": .., "numPartitions": ..}``; without it a table is read
        by a single task, which is only acceptable for small dimensions.
        """
        partitioning = partitioning or {}
        table_names = table_names or {}
        frames = {}
        for name in TABLE_NAMES:
            reader = spark.read.format("jdbc").option("url", url)
            reader = reader.option("dbtable", table_names.get(name, name))
            for key, value in properties.items():
                reader = reader.option(key, value)
            part = partitioning.get(name)
            if part:
                reader = (
                    reader.option("partitionColumn", part["column"])
                    .option("lowerBound", part["lowerBound"])
                    .option("upperBound", part["upperBound"])
                    .option("numPartitions", part["numPartitions"])
                )
            frames[name] = reader.load()
        return cls.from_frames(**frames)

    # --- helpers -----------------------------------------------------------------

    def with_tables(self, **frames: DataFrame) -> "Tables":
        conformed = {n: conform(df, schemas.ALL[n]) for n, df in frames.items()}
        return replace(self, **conformed)

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def register_views(self, prefix: str = "") -> None:
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(prefix + name)
