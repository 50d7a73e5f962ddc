"""Collated order, column formats of dates, counts of coerced values."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from shiftwise.functions import coercion
from shiftwise.plans import clinicians, rosters
from tests.util import make_tables, plan_text, rows, scan_metrics

NAMES = ["Zoe", "Ódhran", "o'Neill", "Odette", "zed", "Adam", "adam", "Åse", "Ase", "Éa", "eb", "(x)", "9 lives"]


def tables(spark, names=NAMES):
    login = datetime(2024, 1, 5, 8)
    return make_tables(
        spark,
        users=[dict(personid=i, fullname=n, adastra=n) for i, n in enumerate(names)],
        rotas=[
            dict(rslid=i, personid=i, truelogin=login, truelogout=login + timedelta(hours=8), durationdecimal=8.0, value="1", date=login)
            for i in range(len(names))
        ],
        consultations=[
            dict(caseno=i, rslid=i, cons_type="Visit", cons_begin_time=login, cons_end_time=login, cons_clinicians_name=n)
            for i, n in enumerate(names)
        ],
    )


def database_order(names):
    con = duckdb.connect()
    con.execute("CREATE TABLE n (name VARCHAR)")
    con.executemany("INSERT INTO n VALUES (?)", [[n] for n in names])
    return [r[0] for r in con.sql("SELECT name FROM n ORDER BY name COLLATE en, name").fetchall()]


def test_names_in_database_order(spark):
    t = tables(spark)
    month = "2024-01-01"
    want = database_order(NAMES)
    assert want.index("o'Neill") < want.index("Odette") < want.index("Ódhran") < want.index("Zoe")
    assert [r["clinician_name"] for r in clinicians.clinician_month(t, month).collect()] == want
    ranked = clinicians.clinician_ranking(t, month).orderBy("place").collect()
    assert [(r["place"], r["clinician_name"]) for r in ranked] == list(enumerate(want, 1))
    options = rosters.adastra_options(t, "UNICODE").orderBy("option_index").collect()
    assert [r["adastra"] for r in options] == database_order([*NAMES, "(All)"])


def test_options_by_code_point(spark):
    options = rosters.adastra_options(tables(spark)).orderBy("option_index").collect()
    assert [(r["option_index"], r["adastra"]) for r in options] == list(enumerate(sorted([*NAMES, "(All)"])))


@pytest.mark.parametrize(
    "texts",
    [
        ["13/01/2024", "02/03/2024", "2024-01-05", "n/a", None, "", "31/12/2023", "30/02/2024"],
        ["2024-01-13", "2024-1-2", "13/01/2024", "2024-01-05 10:00:00", "2024-02-30", "0000-00-00"],
        ["2024-03-31 01:30:00", "2024-10-27 01:30:00", "2024-03-31", "x"],
        ["01/02/2024", "03/04/2024", "12/11/2024"],
        ["5 Jan 2024", "17 Feb 2024", "5 January 2024"],
        [None, "", "never"],
    ],
)
def test_mixed_formats_as_pandas(spark, texts):
    """The first value's format is the commonest here, so both rules agree."""
    import pandas as pd

    spark.conf.set("spark.sql.session.timeZone", "Europe/London")  # has an hour that does not exist
    try:
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
        got = [r["d"] for r in coercion.coerce_dates(df, "d").orderBy("i").collect()]
    finally:
        spark.conf.unset("spark.sql.session.timeZone")
    series = pd.Series(texts)
    want = pd.to_datetime(series, errors="coerce") if any(t and t[0].isdigit() for t in texts) else pd.Series([pd.NaT] * len(texts))
    assert got == [None if w is pd.NaT else w.to_pydatetime() for w in want]


def test_format_is_found_in_one_aggregate(spark):
    df = spark.createDataFrame([("1/2/2024",), ("13/2/2024",), ("2024-01-01",)], "d string")
    assert coercion.infer_format(df, "d") == "d/M/yyyy"
    assert coercion.infer_format(df.filter("false"), "d") is None
    read = coercion.coerce_dates(df, "d")
    assert dict(read.dtypes)["d"] == "timestamp_ntz"


def test_losses_are_counted_on_the_way(spark, tmp_path):
    start = datetime(2024, 1, 1)
    durations = ["8:00", "n/a", None, "90 min", "junk", "8:00:00"]
    t = make_tables(
        spark,
        users=[dict(personid=1, fullname="A", adastra="a")],
        rotas=[
            dict(rslid=i, personid=1, date=start, role="GP", duration=d, value=v)
            for i, (d, v) in enumerate(zip(durations * 10, ["1", "", None] * 20))
        ],
        consultations=[dict(caseno=1, rslid=1, cons_clinicians_name="a")],
    )
    for name, df in t.as_dict().items():
        df.write.parquet(str(tmp_path / name))
    from shiftwise.sources.tables import Tables

    stored = Tables.from_parquet(spark, str(tmp_path))
    losses = Observation("losses")
    report = rosters.daily_role_hours_cost(stored, start, start, losses)
    assert rows(report) == rows(rosters.daily_role_hours_cost(stored, start, start))
    assert losses.get == {"duration": 20, "value": 20}
    again = Observation("again")
    scans = [m for m in scan_metrics(rosters.daily_role_hours_cost(stored, start, start, again)) if "duration" in m["columns"]]
    assert [m["rows"] for m in scans] == [60] and again.get["duration"] == 20  # one pass
    counted = {r["column_name"]: r["n_lost"] for r in rosters.coercion_losses(stored, start, start).collect()}
    assert counted == {"duration": 20, "value": 20}
    assert "CollectMetrics" in plan_text(rosters.duration_hours(stored, Observation("plan")))


def test_losses_of_any_columns(spark):
    df = spark.createDataFrame([("2024-01-01", "5"), ("x", "y"), (None, None)], "d string, n string")
    losses = Observation("any")
    coerced = {"d": (F.col("d"), F.col("d").try_cast("date")), "n": (F.col("n"), F.col("n").try_cast("int"))}
    assert coercion.observe_losses(df, coerced, losses).count() == 3
    assert losses.get == {"d": 1, "n": 1}
