"""Global numbers by ranges written to the shared folder."""

from pyspark.sql import functions as F

from shiftwise.operators.numbering import number_by_range


def test_equals_row_number_and_nulls(spark):
    df = spark.range(0, 5000, 1, 7).select(
        F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.xxhash64("id") % 100).alias("x"), F.col("id").alias("y")
    )
    got = number_by_range(df, [F.col("x").desc_nulls_last(), F.col("y").asc()], out="no")
    rows = [(r["no"], r["x"], r["y"]) for r in got.orderBy("no").collect()]
    expected = sorted(((r["x"], r["y"]) for r in df.collect()), key=lambda v: (v[0] is None, -(v[0] or 0), v[1]))
    assert rows == [(n, x, y) for n, (x, y) in enumerate(expected, 1)]


def test_one_common_prefix_spreads_over_tasks(spark):
    """Names that share a long prefix do not meet in one range."""
    df = spark.range(0, 4000, 1, 4).select(F.format_string("Supplier#%09d", F.col("id")).alias("name"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = number_by_range(df, [F.col("name")], out="no")
        stored = spark.read.parquet(*got.inputFiles())
        files = stored.groupBy(stored["_metadata.file_path"]).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) == 8 and max(r["count"] for r in files) < 1500
    assert [r["name"] for r in got.orderBy("no").collect()] == [f"Supplier#{i:09d}" for i in range(4000)]


def test_empty_table(spark):
    got = number_by_range(spark.range(0).select(F.col("id").alias("x")), [F.col("x")])
    assert got.count() == 0 and got.columns == ["x", "row_no"]
