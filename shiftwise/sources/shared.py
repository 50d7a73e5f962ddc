"""The folder that driver and executors share, and tables written below it.

A table written there cuts lineage: it is computed once, and a lost executor
costs only a new read. Files stay until the folder is cleaned.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset a scratch folder serves a single-process session; on a
    cluster that would lose files, so it is an error there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="shiftwise-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new folder below the shared one and read back."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
