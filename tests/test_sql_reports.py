"""SQL table functions equal the reports; arguments are data."""

from datetime import datetime

import pytest

from shiftwise.functions import sql_reports
from shiftwise.plans import cases, hourly, rosters
from tests.util import plan_text, rows

A, Z = datetime(2024, 1, 2), datetime(2024, 1, 9)


@pytest.fixture(scope="module")
def sql(spark, small_tables):
    made = sql_reports.register(small_tables, prefix="t_")
    assert len(made) == len(set(made)) == 11
    return lambda statement, **args: spark.sql(statement, args=args)


@pytest.mark.parametrize("name", sorted(sql_reports.KEYED))
def test_keyed_functions(sql, small_tables, name):
    report, key, _ = sql_reports.KEYED[name]
    whole = report(small_tables)
    assert rows(sql(f"SELECT * FROM t_{name}(:k)", k=None)) == rows(whole)
    some = whole.filter(f"{key} IS NOT NULL").orderBy(key).first()[key]
    got = sql(f"SELECT * FROM t_{name}(:k)", k=some)
    assert got.columns == whole.columns and rows(got) == rows(whole.filter(whole[key] == some))


@pytest.mark.parametrize(
    "name, report",
    [
        ("calls_by_hour", hourly.calls_by_hour),
        ("call_stats_hourly", hourly.call_stats_hourly),
        ("daily_role_hours_cost", rosters.daily_role_hours_cost),
    ],
)
def test_ranged_functions(sql, small_tables, name, report):
    got = sql(f"SELECT * FROM t_{name}(:a, :z)", a=A, z=Z)
    assert rows(got) == rows(report(small_tables, A, Z)) and got.count() > 0


def test_key_and_range_reach_the_scan(sql):
    assert "EqualTo(l_orderkey,7)" in plan_text(sql("SELECT * FROM t_shift_detail(:k)", k=7))
    text = plan_text(sql("SELECT * FROM t_calls_by_hour(:a, :z)", a=A, z=Z))
    assert "GreaterThanOrEqual(ts,2024-01-02T00:00)" in text


def test_hostile_arguments_are_data(sql, small_tables):
    name = rosters.rotas_clinicians(small_tables).first()["adastra"]
    for text in (f"{name}' OR '1'='1", "x'; DROP VIEW rotas; --", "' UNION SELECT * FROM users --", "%", ""):
        assert sql("SELECT * FROM t_clinician_rotas(:who)", who=text).count() == 0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        sql("SELECT * FROM t_shift_detail(:k)", k="1 OR 1=1").collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        sql("SELECT * FROM t_calls_by_hour(:a, :z)", a="2024-01-01' OR '1'='1", z=Z).collect()


def test_functions_join_in_one_statement(sql, small_tables):
    """Reports compose: kpis of the shifts in a clinician's rotas."""
    name = rosters.rotas_clinicians(small_tables).orderBy("rslid").first()["adastra"]
    got = sql(
        "SELECT k.* FROM t_clinician_rotas(:who) r JOIN t_shift_kpis(NULL) k ON k.rslid = r.rslid",
        who=name,
    )
    own = rosters.rotas_clinicians(small_tables).filter(f"adastra = '{name}'").select("rslid")
    assert rows(got) == rows(cases.shift_kpis(small_tables).join(own, "rslid"))
