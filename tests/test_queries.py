"""Every named query with SQL runs next to it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import compare, connect

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, small, name):
    status, detail = compare(spark, con, small, name, entry.queries()[name], ORACLES[name])
    assert status == "ok", detail


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0
    assert {"compound_id", "prob", "predicted", "rank", "threshold"} <= set(out.columns)
