"""Queries that SQL can express: the same rows on Spark and DuckDB."""

import pytest
from compare import connect, same

from driftline.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert same(spark, connect(SMALL), QUERIES[name], ORACLES[name], SMALL) == ""


def test_all_operators_are_registered():
    import __spark_entry__ as entry
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
