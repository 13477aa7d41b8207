"""Distinct counts by hashes, and roles settled by sketches."""

from __future__ import annotations

import pytest
from conftest import load
from pyspark.sql import functions as F

from tallyline.functions import distinct
from tallyline.operators import diagnostics, profile

WIDE = 50


def plan(frame) -> str:
    return frame._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["lineitem", "orders", "events", "documents"])
def test_roles_are_those_of_exact_counts(spark, name):
    frame = load(spark, name)
    exact = {row["column"]: (row["role"], row["null_count"]) for row in profile.column_profile(frame).collect()}
    found = profile.role_profile(frame).collect()
    assert {row["column"]: (row["role"], row["null_count"]) for row in found} == exact


def test_few_columns_need_exact_counts(spark):
    rows = profile.role_profile(load(spark, "lineitem")).collect()
    assert sum(row["distinct_count"] is not None for row in rows) <= 1


def test_limits_are_decided_exactly(spark):
    """989 and 979 of 1,000 values are distinct, around the limit of 0.98, and 200 and 201 around that of a fifth."""
    frame = spark.range(1000).select(
        F.greatest(F.col("id"), F.lit(11)).alias("unique"),
        F.greatest(F.col("id"), F.lit(21)).alias("below"),
        F.when(F.col("id") > 19, F.col("id")).alias("nulls"),
        (F.col("id") % 200).cast("string").cast("binary").alias("few"),
        (F.col("id") % 201).cast("string").cast("binary").alias("many"),
        (F.col("id") % 2 == 0).alias("flag"),
    )
    rows = {row["column"]: row for row in profile.role_profile(frame).collect()}
    assert {name: row["role"] for name, row in rows.items()} == {
        "unique": "id", "below": "measure", "nulls": "measure", "few": "dimension", "many": "unknown", "flag": "dimension"
    }
    assert {name: row["distinct_count"] for name, row in rows.items()} == {
        "unique": 989, "below": 979, "nulls": None, "few": 200, "many": 201, "flag": None
    }


def test_values_with_one_hash_are_one_value(spark):
    frame = spark.createDataFrame([(0.0, "a"), (-0.0, "A"), (float("nan"), None), (float("nan"), ""), (None, "a")], "x double, t string")
    rows = {row["ordinal"]: tuple(row)[1:] for row in distinct.column_counts(frame, ["x", "t"], ["x"]).collect()}
    assert rows == {0: (5, 1, 2), 1: (5, 1, 3), 2: (5, 1, None)}
    assert distinct.column_counts(frame.limit(0), ["x"]).count() == 0


def test_many_dimensions_take_one_scan_without_expand(spark):
    names = [f"c{n}" for n in range(WIDE)]
    frame = load(spark, "lineitem").select("l_shipdate", *[(F.col("l_partkey") % (n + 2)).alias(name) for n, name in enumerate(names)])
    unstable = diagnostics.instability(frame, "l_shipdate", names)
    counted = diagnostics.count_row(frame, ["l_shipdate"], names, "c7")
    for found in (unstable, counted):
        text = plan(found)
        physical = text[text.index("== Physical Plan ==") :]
        assert "Expand" not in physical and physical.count("FileScan") == 1
    row, total = counted.first(), frame.count()
    assert [row[f"distinct{n}"] for n in range(WIDE)] == [n + 2 for n in range(WIDE)]
    assert (row["row_count"], row["nulls0"], row["duplicates"]) == (total, 0, total - 9)
    by_month = frame.groupBy(F.trunc("l_shipdate", "month")).agg(F.countDistinct("c49").alias("n")).agg(F.max("n"), F.min("n")).first()
    assert tuple(unstable.where("dimension = 'c49'").select("max_count", "min_count").first()) == tuple(by_month)


def test_months_with_nulls_alone_count_no_value(spark):
    rows = [("2024-01-03", None), ("2024-02-03", "a"), ("2024-02-04", "b")]
    frame = spark.createDataFrame(rows, "day string, kind string").withColumn("day", F.to_date("day"))
    row = diagnostics.instability(frame, "day", ["kind"]).first()
    assert (row["max_count"], row["min_count"], row["explosion_ratio"]) == (2, 0, 2.0)
    empty = diagnostics.count_row(frame.limit(0), ["day"], ["kind"], "kind").first()
    assert tuple(empty) == (0, 0, 0, 0)
