"""Every registered query equals its DuckDB oracle (sf0.001; the driver uses sf0.01)."""

import pytest

import __spark_entry__ as E
from shiftwise.plans import registry
from tests.conftest import SF_SMALL
from tests.harness import compare, duck_connect

QUERIES = {name: query for name, query in E.queries().items() if name in registry.REPORTS}
ORACLE = {name: sql for name, sql in E.oracle_sql().items() if name in registry.REPORTS}


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF_SMALL), con, ORACLE[name])
    assert ok, msg


def test_entry_flagship(spark):
    df = E.entry(spark)
    assert df.count() == 169
    assert df.columns[0] == "hour"
