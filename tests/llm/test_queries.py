"""The queries against their SQL over the given tables, and the guard around the package."""

from __future__ import annotations

import pytest
from compare import connect, differences, duck_table, spark_table
from conftest import SF_DIR

import __spark_entry__ as entry_points
from tallyline.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, name):
    ours = spark_table(QUERIES[name](spark, SF_DIR))
    assert not differences(ours, duck_table(connect(SF_DIR), ORACLE[name]))


def test_one_query_for_each_operator():
    names = entry_points.queries()
    assert [sum(name.startswith(f"op{n}_") for name in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(ORACLE) <= set(entry_points.oracle_sql())
