import pytest

from shiftwise.llm import queries as Q
from tests.conftest import SF_SMALL
from tests.harness import compare, duck_connect


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_oracle(spark, name):
    ok, msg = compare(Q.QUERIES[name](spark, SF_SMALL), duck_connect(SF_SMALL), Q.ORACLE[name])
    assert ok, msg
