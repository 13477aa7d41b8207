"""Every registered query against its SQL over the given tables."""

from __future__ import annotations

import pytest
from compare import connect, differences, duck_table, spark_table
from conftest import SF_DIR

import __spark_entry__ as entry_points
from registry import oracle, queries

QUERIES = queries.QUERIES
ORACLE = oracle.ORACLE


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours = spark_table(QUERIES[name](spark, SF_DIR))
    assert not differences(ours, duck_table(duck, ORACLE[name]))


def test_all_are_registered():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLE) <= set(entry_points.oracle_sql())


def test_entry(spark):
    report = entry_points.entry(spark)
    assert report.columns[:2] == ["rank", "title"]
    assert report.count() > 0
