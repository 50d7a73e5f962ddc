"""The layout by months and keys: same rows, fewer files and row groups read."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shiftwise.plans import cases, clinicians
from shiftwise.sources.layouts import read_layout, with_login_months, write_layout
from shiftwise.sources.tables import LOGIN_MONTH
from tests.util import make_tables, rows, scan_metrics

MONTH = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    from shiftwise.sources.fixtures import derive_tables

    tables = derive_tables(spark, "/root/testdata/sf0.01")
    root = str(tmp_path_factory.mktemp("layout") / "t")
    write_layout(tables, root, files=8, keys_a_group=2000, row_group_bytes=32 << 10)
    return tables, read_layout(spark, root)


def test_same_rows(laid_out):
    plain, laid = laid_out
    for name, df in plain.as_dict().items():
        assert rows(laid.as_dict()[name].drop(LOGIN_MONTH)) == rows(df), name


@pytest.mark.parametrize(
    "report", [clinicians.clinician_month, clinicians.clinician_shifts]
)
def test_month_reports_are_equal_and_read_their_month(laid_out, report):
    plain, laid = laid_out
    got = report(laid, MONTH)
    assert rows(got) == rows(report(plain, MONTH))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "login_month" in text
    own = laid.consultations.filter(F.col(LOGIN_MONTH).isin("2024-01", "mixed"))
    files = own.select(own["_metadata.file_path"]).distinct().count()
    assert files < len(laid.consultations.inputFiles())
    read = [m for m in scan_metrics(got) if "cons_type" in m["columns"]]
    assert read and all(m["rows"] <= own.count() and m["files"] <= files for m in read)


def test_files_in_proportion_to_the_month(laid_out):
    _, laid = laid_out
    counts = {r[LOGIN_MONTH]: r["count"] for r in laid.consultations.groupBy(LOGIN_MONTH).count().collect()}
    assert len(counts) > 2
    months = [m for m in sorted(counts) if m[:2] == "20"]
    read = {}
    for m in months:
        got = clinicians.consultation_stats_month(laid, m + "-01")
        read[m] = sum(x["rows"] for x in scan_metrics(got) if "cons_type" in x["columns"])
    assert read == {m: counts[m] + counts.get("mixed", 0) for m in months}


@pytest.mark.parametrize(
    "report, key, column, table",
    [
        (cases.shift_detail, "rslid", "cons_begin_time", "consultations"),
        (cases.case_detail, "caseno", "cons_begin_time", "consultations"),
        (cases.case_header, "caseno", "cons_begin_time", "consultations"),
        (cases.shift_detail, "rslid", "truelogin", "rotas"),
        (cases.survey_feedback, "caseno", "satisfaction", "surveys"),
    ],
)
def test_one_key_reads_a_bounded_share(laid_out, report, key, column, table):
    """Scan metrics: of a table's row groups a lookup reads those of its key."""
    plain, laid = laid_out
    total = laid.as_dict()[table].count()
    groups = max(1, total // 2000)
    for k in [r[0] for r in plain.as_dict()[table].select(key).distinct().orderBy(F.xxhash64(key)).limit(2).collect()]:
        got = report(laid, k)
        assert rows(got) == rows(report(plain, k))
        for m in scan_metrics(got):
            if column in m["columns"]:
                assert m["rows"] <= max(0.25 * total, total / groups + 2000), (k, m)


def test_clinician_lookup_reads_a_bounded_share(laid_out):
    plain, laid = laid_out
    person = plain.rotas.filter("truelogout IS NOT NULL").orderBy("rslid").first()["personid"]
    got = clinicians.clinician_shifts(laid, MONTH, person)
    assert rows(got) == rows(clinicians.clinician_shifts(plain, MONTH, person))


def test_shift_listed_in_two_months_and_orphans(spark, tmp_path):
    login = datetime(2024, 1, 31, 20)
    t = make_tables(
        spark,
        users=[dict(personid=1, fullname="A", adastra="a")],
        rotas=[
            dict(rslid=1, personid=1, truelogin=login, truelogout=login + timedelta(hours=8)),
            dict(rslid=1, personid=1, truelogin=login + timedelta(days=3), truelogout=login + timedelta(days=3, hours=8)),
            dict(rslid=2, personid=1, truelogin=None, truelogout=None),
        ],
        consultations=[
            dict(caseno=i, rslid=s, cons_type="Advice", cons_begin_time=login, cons_end_time=login + timedelta(minutes=5))
            for i, s in enumerate([1, 1, 2, 3, None])
        ],
    )
    months = {r["caseno"]: r[LOGIN_MONTH] for r in with_login_months(t).consultations.collect()}
    assert months == {0: "mixed", 1: "mixed", 2: "none", 3: "none", 4: "none"}
    write_layout(t, str(tmp_path / "t"), files=2)
    laid = read_layout(spark, str(tmp_path / "t"))
    for month in ("2024-01-01", "2024-02-01", "2024-03-01"):
        assert rows(clinicians.shift_consultation_stats(laid, month)) == rows(clinicians.shift_consultation_stats(t, month))
    assert rows(cases.case_detail(laid)) == rows(cases.case_detail(t))
