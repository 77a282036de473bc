"""Every registered query against its SQL twin on whole small tables."""

import pytest

import __spark_entry__ as entry
from check import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, db, small):
    problem, rows = compare(QUERIES[name], ORACLES.get(name), spark, db, small)
    assert problem is None
    assert rows > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["query_id", "rank"]
