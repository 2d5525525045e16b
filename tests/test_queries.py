"""All registered queries against their SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check_queries import differences, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    text, ok = differences(spark, con, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, text
