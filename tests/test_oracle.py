"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as spark_entry
from oracle_check import connect, difference
from tickloom.plans import oracle, registry

QUERIES, SQL = registry.REGISTRY, oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_names():
    assert set(SQL) == set(QUERIES)


# A stock or a category that the smallest tables do not hold.
MAY_BE_EMPTY = {"point_filter", "q_candles", "obi_series", "scan_parquet"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, con, name):
    found = difference(QUERIES[name](spark, sf_dir), con, SQL[name])
    assert found is None or (found == "no rows" and name in MAY_BE_EMPTY), found


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
