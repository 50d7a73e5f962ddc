"""Shared folder, written tables and input columns."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts are long: few rows in each batch that Python workers hold.
_BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is empty, a scratch folder serves a single-process
    session; on a cluster that would lose files, so it is an error there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new folder below the shared one and read back:
    computed once, with a short lineage that a lost executor cannot break."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    rows = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(rows), _BATCH_ROWS) if int(rows) > 0 else _BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, rows)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def field(df: DataFrame, name: str, kind: str) -> Column:
    """Column ``name`` of ``df`` cast to ``kind``; null where there is none."""
    return (df[name] if name in df.columns else F.lit(None)).cast(kind).alias(name)


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(field(docs, "doc_id", "long"), field(docs, "text", "string"))


def with_place(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``_llm_file`` and ``_llm_row``: where each row is stored.

    The place names a row even when ids repeat or are null. It is stable only
    for a plain Parquet scan, so ``docs`` must be a stored table (use
    ``write_table`` first for anything else).
    """
    meta = docs.metadataColumn("_metadata")
    return docs.select(
        "*", meta.getField("file_path").alias("_llm_file"), meta.getField("row_index").alias("_llm_row")
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    out = Path(tempfile.mkdtemp(prefix="llm-sources-")) / "shiftwise_sources.zip"  # the driver serves it from here
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted((root / "shiftwise").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package importable in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows: a task holds the Python texts of one piece."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


SLOT_BITS = 24


def slot_bitmap(hashes: DataFrame, least: int = 1) -> DataFrame:
    """A bit per slot (a hash ``h`` modulo 2 ** SLOT_BITS) that at least
    ``least`` rows fall in: at most 512 rows of 4 KB, whatever the input.

    As a filter it lets every wanted row pass, and others that share a slot
    with one; what passes must still be joined exactly.
    """
    slots = hashes.groupBy(F.pmod("h", F.lit(1 << SLOT_BITS)).alias("s"))
    full = slots.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return full.groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")
    )


def split_by_slot(df: DataFrame, h: Column, bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose hash has its bit set, and the others."""
    slot = F.pmod(h, F.lit(1 << SLOT_BITS))
    at = F.bitmap_bit_position(slot)
    byte = F.expr("conv(hex(substring(_llm_bits, cast(_llm_pos div 8 as int) + 1, 1)), 16, 10)").cast("int")
    bit = byte.bitwiseAND(F.expr("shiftleft(1, cast(_llm_pos % 8 as int))")) > 0
    named = F.broadcast(bitmap.select(F.col("bucket").alias("_llm_bucket"), F.col("bits").alias("_llm_bits")))
    j = df.withColumn("_llm_pos", at).join(named, F.bitmap_bucket_number(slot) == F.col("_llm_bucket"), "left")
    hit = F.coalesce(bit, F.lit(False))
    return tuple(j.filter(f).drop("_llm_pos", "_llm_bucket", "_llm_bits") for f in (hit, ~hit))


def without_places(src: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the rows of ``src`` (of ``with_place``) whose place is not
    in ``gone``, a written table of _llm_file and _llm_row. Rows whose slot is
    free of places that go are not shuffled."""
    gone = gone.select(F.col("_llm_file").alias("_llm_gfile"), F.col("_llm_row").alias("_llm_grow"))
    marks = slot_bitmap(gone.select(F.xxhash64("_llm_gfile", "_llm_grow").alias("h")))
    touched, others = split_by_slot(src, F.xxhash64("_llm_file", "_llm_row"), marks)
    same = (F.col("_llm_file") == F.col("_llm_gfile")) & (F.col("_llm_row") == F.col("_llm_grow"))
    names = [F.col(f"`{c}`") for c in columns]
    return touched.join(gone, same, "left_anti").select(*names).union(others.select(*names))


def bitmap_bytes(bitmap: DataFrame) -> bytes:
    """The whole bitmap (2 MB) on the driver, for Python tasks; bit s is bit
    s % 8 of byte s // 8."""
    out = bytearray(1 << (SLOT_BITS - 3))
    first = {}
    for r in bitmap.collect():
        first[r["bucket"]] = bytes(r["bits"])
    # bucket 0 holds slot 0 only; bucket b holds slots (b - 1) * 32768 + 1 ... b * 32768
    for bucket, bits in first.items():
        if bucket == 0:
            out[0] |= bits[0] & 1
            continue
        n = int.from_bytes(bits, "little") << (1)
        start = (bucket - 1) * 4096
        part = n.to_bytes(4097, "little")
        for i, b in enumerate(part):
            if b and start + i < len(out):
                out[start + i] |= b
    return bytes(out)
