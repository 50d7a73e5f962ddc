"""Physical plan properties that matter at scale."""

from datetime import datetime

from shiftwise.plans import clinicians, hourly
from shiftwise.sources.tables import Tables


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_staff_per_hour_has_no_nested_loop(small_tables):
    text = plan_text(hourly.staff_per_hour(small_tables, datetime(2024, 1, 2), datetime(2024, 1, 9)))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "Generate" in text


def test_month_range_reaches_parquet_scan(spark, small_tables, tmp_path):
    for name, df in small_tables.as_dict().items():
        df.write.parquet(str(tmp_path / name))
    t = Tables.from_parquet(spark, str(tmp_path))
    text = plan_text(clinicians.shift_hours_month(t, datetime(2024, 1, 1)))
    assert "GreaterThanOrEqual(truelogin,2024-01-01T00:00)" in text
    assert "LessThan(truelogin,2024-02-01T00:00)" in text


def test_hourly_range_reaches_parquet_scan(small_tables):
    text = plan_text(hourly.call_stats_hourly(small_tables, datetime(2024, 1, 2), datetime(2024, 1, 9)))
    assert "GreaterThanOrEqual(ts,2024-01-02T00:00)" in text


def test_consultation_stats_use_no_expand(small_tables):
    text = plan_text(clinicians.consultation_stats_month(small_tables, datetime(2024, 1, 1)))
    assert "Expand" not in text


def test_hot_shift_is_split_by_aqe(spark):
    """A third of all consultations on one shift: the inner half of the
    skew-safe outer join gets its hot partition split at runtime."""
    from datetime import timedelta

    from shiftwise.plans import cases
    from tests.util import make_tables

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    saved = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        t0 = datetime(2024, 1, 2)
        rotas = [dict(rslid=i, personid=i % 7, truelogin=t0, truelogout=t0 + timedelta(hours=8)) for i in range(200)]
        cons = [
            dict(
                caseno=i,
                rslid=0 if i % 3 == 0 else i % 200,
                cons_begin_time=t0 + timedelta(minutes=i),
                cons_end_time=t0 + timedelta(minutes=i + 5),
            )
            for i in range(30000)
        ]
        t = make_tables(spark, rotas=rotas, consultations=cons)
        df = cases.shift_detail(t)
        rows = df.collect()
        assert len(rows) == t.rotas.join(t.consultations, "rslid", "left").count()
        assert "SortMergeJoin(skew=true)" in plan_text(df)
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_shift_statistics_combine_before_they_are_dealt(spark, small_tables):
    """Raw rows are not dealt by (shift, case): only what the join's tasks combined is."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_text(clinicians.shift_consultation_stats(small_tables, datetime(2024, 1, 1)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.splitlines()
    dealt = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line and "caseno" in line]
    assert len(dealt) == 1 and "partial_" in lines[dealt[0] + 1] and "REPARTITION" not in text
