"""Every registered query of the study library against DuckDB on the smallest tables."""

import pytest
from compare_oracle import check, connect

import __spark_entry__ as entry
from trialloom.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    result, _ = check(spark, con, sf, name, QUERIES[name], ORACLES[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry.entry(spark).count() == 8
