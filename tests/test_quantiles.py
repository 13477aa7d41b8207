"""Exact medians by narrowing, against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyline.functions import quantiles
from tallyline.functions.quantiles import exact_medians
from tallyline.operators import profile


def test_hard_columns(spark):
    n = 20_000
    even = F.col("id") % 2 == 0
    frame = spark.range(n).select(
        F.when(even, 0.0).otherwise(1.0).alias("two_values"),
        F.when(F.col("id") < n * 0.6, float("nan")).otherwise(1.0).alias("mostly_nan"),
        F.when(F.col("id") < n * 0.3, float("nan")).otherwise(F.rand(1)).alias("some_nan"),
        F.exp(F.randn(3) * 50).alias("heavy_tail"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.randn(5)).alias("third_equal"),
        F.lit(None).cast("double").alias("empty"),
        F.when(F.col("id") == 7, 3.5).alias("single"),
        (F.col("id") * 1.0).alias("sequence"),
        F.when(even, F.lit(-1.0)).otherwise(F.lit(1.0) + F.rand(2)).alias("gap"),
    )
    frame.cache()
    wanted = frame.agg(*[F.median(name).alias(name) for name in frame.columns]).first().asDict()
    found = exact_medians(frame, {name: F.col(name) for name in frame.columns}, fetch_rows=20)
    for name, value in wanted.items():
        same = found[name] == value or (value is not None and math.isnan(value) and math.isnan(found[name]))
        assert same, name


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e9, 1e9)), min_size=1, max_size=300))
def test_any_values(spark, values):
    frame = spark.createDataFrame([(value,) for value in values], "v double")
    assert exact_medians(frame, {"v": F.col("v")}, fetch_rows=3)["v"] == pytest.approx(float(np.median(values)))


def test_profile_of_a_large_table(spark, monkeypatch):
    """What is fetched for a median is bounded, in all and for one column."""
    monkeypatch.setattr(quantiles, "FETCH_ROWS", 10)
    monkeypatch.setattr(quantiles, "FETCHED_AT_ONCE", 12)
    frame = spark.range(1001).select("id", (F.col("id") * 2.5).alias("amount"))
    rows = profile.numeric_profile(frame).collect()
    assert [row["median"] for row in rows] == [500.0, 1250.0]
    columns = profile.column_profile(frame).collect()
    assert [row["distinct_count"] for row in columns] == [1001, 1001]
    assert [row["role"] for row in columns] == ["id", "id"]
    approx = profile.column_profile(frame, approx=True).collect()
    assert all(abs(row["distinct_count"] - 1001) < 100 for row in approx)
    assert profile.top_values(frame).count() == 10


def test_rules_hold_beyond_a_quarter_million_rows(spark):
    frame = spark.range(260_000).select(
        (F.col("id") % 130_000).alias("half"), (F.col("id") * 1.5).alias("amount"), (F.col("id") % 7).cast("string").alias("kind")
    )
    rows = {row["column"]: row for row in profile.column_profile(frame).collect()}
    assert {name: (row["distinct_count"], row["role"]) for name, row in rows.items()} == {
        "half": (130_000, "measure"), "amount": (260_000, "id"), "kind": (7, "dimension")
    }
    tops = [tuple(row) for row in profile.top_values(frame).where("column = 'kind'").orderBy("place").collect()]
    assert tops[0] == ("kind", "0", 37143, 1) and len(tops) == 5


def test_values_are_counted_once_whatever_their_type(spark):
    frame = spark.sql("SELECT * FROM VALUES (0.0D, X'00', 'a'), (-0.0D, X'00', 'A'), (double('NaN'), X'FF', null) AS t(d, b, s)")
    assert [row["distinct_count"] for row in profile.column_profile(frame).orderBy("ordinal").collect()] == [2, 2, 2]
