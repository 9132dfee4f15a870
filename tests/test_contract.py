"""The registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from tools.check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
ALL = contract.queries()
SQL = contract.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(ALL) and len(SQL) > 110


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables here")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert compare(ALL[name](spark, SF_DIR), duck, SQL[name]) is None


def test_entry(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables here")
    assert contract.entry(spark).count() > 0
