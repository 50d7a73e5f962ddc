"""Exact deduplication as a stateful stream.

Documents arrive as a log of (digest, id, place): the digest of the whole
text, the stable id and the content locator (file and row). A Structured
Streaming aggregation keyed by the digest keeps, in RocksDB on disk and
without expiry, the id and locator of the row that stays and the number of
rows seen. Rows of a digest are combined before the shuffle, so a text that
a third of all documents share reaches its state as a row per task. Changes
of the state leave each micro-batch as a table; the last change of a digest
is its state.

A digest seen more than once is a hit, and each hit is checked: the row's
full text against the text at the locator of the row that stays (rows that a
bitmap of bounded size shows to be no hit are not shuffled for it). Should a
digest stand for different texts, its rows are grouped by the texts instead,
so the result holds for any digest function.

The row with the largest doc_id stays (null ids last); of rows equal in it
too, the one that is stored last. A null text counts as empty. An empty table
gives an empty result. ``docs`` must be a stored table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwise.llm.common import new_folder, slot_bitmap, split_by_slot, with_place, without_places, write_table

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def keyed_state(log_path: str, log: DataFrame, max_bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """Stream the log below ``log_path`` (digest, doc_id, _llm_file, _llm_row) through
    the keyed state; returns (digest, group_size, keep) of every digest."""
    spark = log.sparkSession
    own = spark.newSession()  # the caller's settings stay as they are
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "64")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB", "4")
    # many small states: no files of megabytes laid out ahead for each
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    changes = new_folder(spark, "dedup-state")
    state = (
        own.readStream.schema(log.schema)
        .option("maxBytesPerTrigger", str(max_bytes_per_trigger))
        .parquet(log_path)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "_llm_file", "_llm_row")).alias("keep"))
    )

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    query = (
        state.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", new_folder(spark, "dedup-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = "digest string, group_size long, keep struct<doc_id: long, _llm_file: string, _llm_row: long>, batch int"
    seen = spark.read.schema(schema).parquet(changes) if query.lastProgress else spark.createDataFrame([], schema)
    # counts only grow, so the largest is the last
    return seen.groupBy("digest").agg(
        F.max("group_size").alias("group_size"), F.max_by("keep", "group_size").alias("keep")
    )


def exact_duplicates(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, max_bytes_per_trigger: int = 1 << 30
) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, digest, and its
    place (_llm_file, _llm_row)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = with_place(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), "_llm_file", "_llm_row", text.alias("text")
    )
    path = new_folder(spark, "dedup-log")
    rows.drop("text").write.parquet(path)
    log = spark.read.schema(rows.drop("text").schema).parquet(path)
    state = keyed_state(path, log, max_bytes_per_trigger)

    # full bytes of each hit against the row that stays
    many = write_table(
        state.filter(F.col("group_size") > 1).select(
            "digest", F.col("keep._llm_file").alias("_llm_kfile"), F.col("keep._llm_row").alias("_llm_krow")
        ),
        "dedup-hits",
    )
    marks = slot_bitmap(many.select(F.xxhash64("digest").alias("h")))
    texts, _ = split_by_slot(rows.select("digest", "_llm_file", "_llm_row", "text"), F.xxhash64("digest"), marks)
    stays = (F.col("_llm_file") == F.col("_llm_kfile")) & (F.col("_llm_row") == F.col("_llm_krow"))
    # written, so that the join below deals both sides anew and can split a hot digest
    content = write_table(
        texts.join(many.withColumnRenamed("digest", "c_digest"), (F.col("digest") == F.col("c_digest")) & stays).select(
            "c_digest", "_llm_kfile", "_llm_krow", F.col("text").alias("content")
        ),
        "dedup-content",
    )
    mixed = (
        texts.join(content, F.col("digest") == F.col("c_digest"))
        .filter(~stays & (F.col("text") != F.col("content")))
        .select("digest")
        .checkpoint()
        .distinct()
    )
    kept = (F.col("_llm_file") == F.col("keep._llm_file")) & (F.col("_llm_row") == F.col("keep._llm_row"))

    def answer(of: DataFrame) -> DataFrame:
        return of.select(
            "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "digest", "_llm_file", "_llm_row"
        )

    if mixed.isEmpty():
        return answer(log.join(state, "digest"))
    by_text = (
        rows.join(mixed, "digest", "left_semi")
        .groupBy("digest", "text")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "_llm_file", "_llm_row")).alias("keep"))
    )
    return answer(log.join(mixed, "digest", "left_anti").join(state, "digest")).union(
        answer(rows.join(by_text, ["digest", "text"]))
    )


def keep_last(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that repeat a text; the columns stay as they are."""
    gone = exact_duplicates(docs).filter(~F.col("kept")).select("_llm_file", "_llm_row")
    return without_places(with_place(docs), write_table(gone, "dedup-gone"), docs.columns)
