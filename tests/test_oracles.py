"""Every registered query that SQL can express gives the rows DuckDB gives."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from check import compare, connection
from conftest import DATA


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    problem, rows = compare(spark, con, DATA, name, contract.oracle_sql()[name])
    assert problem is None
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    profile = contract.entry(spark)
    assert profile.count() == 11
    assert {"column", "type", "null_count", "distinct_count", "mean"} <= set(profile.columns)
