import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shiftwise.session import build_session

    s = build_session("local[*]", app_name="shiftwise-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_tables(spark):
    from shiftwise.sources.fixtures import derive_tables

    return derive_tables(spark, SF_SMALL)
