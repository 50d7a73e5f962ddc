"""Streaming hourly call stats equal the batch report; snapshots read back equal."""

from datetime import datetime

from shiftwise.plans import hourly
from shiftwise.sources.snapshot import write_clustered
from shiftwise.sources.tables import Tables
from shiftwise.streaming.hourly_calls import hourly_call_stats_stream, read_calls_stream


def test_stream_equals_batch(spark, small_tables, tmp_path):
    src = str(tmp_path / "calls")
    small_tables.phone_calls.write.parquet(src)
    stream = hourly_call_stats_stream(read_calls_stream(spark, src), lateness="0 seconds")
    q = (
        stream.writeStream.outputMode("complete")
        .format("memory")
        .queryName("hourly_calls_test")
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .start()
    )
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("hourly_calls_test").collect())
    batch = hourly.call_stats_hourly(small_tables, datetime(1900, 1, 1), datetime(2100, 1, 1))
    want = sorted(tuple(r) for r in batch.collect())
    assert got == want


def test_clustered_snapshot_reads_back(spark, small_tables, tmp_path):
    root = str(tmp_path / "snap")
    write_clustered(small_tables, root, files=4)
    back = Tables.from_parquet(spark, root)
    for name, df in small_tables.as_dict().items():
        assert sorted(map(tuple, back.as_dict()[name].collect()), key=str) == sorted(
            map(tuple, df.collect()), key=str
        ), name
