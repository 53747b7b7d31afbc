"""Every registered query with SQL gives the same rows on Spark and DuckDB."""

import pytest
from compare import connect, same
from helpers import SMALL

from driftline.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert same(spark, con, QUERIES[name], ORACLES[name], SMALL) in ("", "both empty")


def test_entry_point():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry_runs(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 15
