"""Empty tables, nulls, zeros and ties."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyline.functions.text import fixed_sql, percent_sql, plain_number
from tallyline.models import Dimension, SemanticModel
from tallyline.operators import diagnostics, profile, segments, semantic, series
from tallyline.plans import modules
from tallyline.plans.report import run_analysis
from tallyline.plans.tasks import plan_tasks


def table(spark, rows):
    return spark.createDataFrame(rows, "day string, kind string, amount int, note string").withColumn(
        "day", F.col("day").cast("date")
    )


def months(spark, values, first=1):
    rows = [(f"2024-{first + i:02d}-01", "k", value, None) for i, value in enumerate(values)]
    return series.period_values(table(spark, rows), "SUM(amount)", "day", "month")


def test_empty_table(spark):
    frame = table(spark, []).limit(0)
    columns = {row["column"]: row for row in profile.column_profile(frame).collect()}
    assert columns["amount"]["null_rate"] == 0
    assert columns["amount"]["role"] == "measure"
    titles = [row["title"] for row in run_analysis("none", frame).ranked.orderBy("rank").collect()]
    assert "total_amount volatility" in titles
    assert "No critical diagnostics alerts" in titles
    headline = run_analysis("none", frame, mode="overview").findings.filter("title like 'Headline%'").first()
    assert headline["observation"] == "Current aggregate value for total_amount is None"
    assert headline["caveats"] == ["Metric returned null"]
    assert segments.segment_summary(frame, "SUM(amount)", "kind").count() == 0
    assert segments.segment_summary(frame, "SUM(amount)", "kind").count() == 0


def test_one_row(spark):
    frame = table(spark, [("2024-01-01", "a", 5, None)])
    assert series.trend_deltas(months(spark, [5])).count() == 0
    summary = series.trend_summary(months(spark, [5])).first()
    assert summary["max_increase"] is None
    assert summary["volatility_ratio"] == 0
    titles = {row["title"] for row in run_analysis("one", frame).ranked.collect()}
    assert not any(title.startswith("Strongest") for title in titles)
    assert "Data missingness risk" in titles


def test_zero_previous_and_null_value(spark):
    rows = [row.asDict() for row in series.trend_deltas(months(spark, [0, 4, None, 6])).orderBy("period").collect()]
    assert [(row["delta"], row["relative_delta"]) for row in rows] == [(4, None), (-4, -1), (6, None)]


def test_constant_series(spark):
    scores = series.anomaly_scores(months(spark, [3, 3, 3, 3])).collect()
    assert {(row["z_score"], row["mad_score"]) for row in scores} == {(0.0, 0.0)}
    assert series.trend_summary(months(spark, [3, 3, 3])).first()["volatility_ratio"] == 0
    assert series.anomaly_summary(months(spark, [3, 3, 3, 3])).first()["pattern"] == "none"


def test_too_few_periods(spark):
    assert series.anomaly_flags(months(spark, [1, 1, 1000])).count() == 0
    assert series.trend_spikes(months(spark, [1, 1000])).count() == 0


def test_one_and_many_anomalies(spark):
    once = series.anomaly_summary(months(spark, [10, 11, 10, 11, 10, 500])).first()
    assert (once["pattern"], once["severity"], once["anomalies"]) == ("one-off", "medium", 1)
    twice = series.anomaly_summary(months(spark, [10, 11, 10, 11, 10, 500, 10, 400])).first()
    assert (twice["pattern"], twice["severity"]) == ("persistent", "high")
    flag = series.anomaly_flags(months(spark, [10, 11, 10, 11, 10, 500])).first()
    assert (flag["value"], flag["absolute_delta"], flag["relative_delta"]) == (500, 490, 49)


def test_first_of_equal_moves(spark):
    summary = series.trend_summary(months(spark, [1, 3, 1, 3, 1])).first()
    assert summary["max_increase_period"] == datetime(2024, 2, 1)
    assert summary["max_decrease_period"] == datetime(2024, 3, 1)


def test_null_period_is_last(spark):
    frame = table(spark, [("2024-01-01", "a", 1, None), (None, "a", 7, None), ("2024-02-01", "a", 2, None)])
    found = series.metric_series(frame, {"v": "SUM(amount)"}, "day", "month").orderBy(F.col("period").asc_nulls_last())
    assert [row["v"] for row in found.collect()] == [1, 2, 7]
    values = series.period_values(frame, "SUM(amount)", "day", "month")
    assert series.trend_summary(values).first()["last_value"] == 7


def test_grains(spark):
    with pytest.raises(ValueError, match="Unsupported grain"):
        months_frame = table(spark, [("2024-01-01", "a", 1, None)])
        series.metric_series(months_frame, {"v": "SUM(amount)"}, "day", "hour")


def test_text_times(spark):
    """A text column that is a time by its name: what is no timestamp is null."""
    frame = spark.createDataFrame([("2024-01-05 10:00:00", 1), ("soon", 2)], "created_at string, v int")
    ranges = profile.dataset_date_range(frame, ["created_at"]).first()
    assert ranges["date_min"] == ranges["date_max"] == datetime(2024, 1, 5, 10)
    frame = spark.createDataFrame([(5, "x")], "update_count int, name string")
    assert {r["column"]: r["role"] for r in profile.column_profile(frame).collect()}["update_count"] == "time"
    assert profile.date_ranges(frame, ["update_count"]).first()["date_min"] is None


def test_null_segment_and_ties(spark):
    frame = table(spark, [("2024-01-01", None, 5, None), ("2024-01-01", "b", 5, None), ("2024-01-01", "a", 5, None)])
    ranked = segments.segment_ranking(frame, "SUM(amount)", "kind").orderBy("place").collect()
    assert [row["segment"] for row in ranked] == ["a", "b", None]
    assert segments.segment_summary(frame, "SUM(amount)", "kind").first()["loser"] == "None"


def test_null_metric_ranks_last(spark):
    frame = table(spark, [("2024-01-01", "a", None, None), ("2024-01-01", "b", -5, None)])
    ranked = segments.segment_ranking(frame, "SUM(amount)", "kind").orderBy("place").collect()
    assert [(row["segment"], row["value"]) for row in ranked] == [("b", -5.0), ("a", 0.0)]
    assert segments.segment_summary(frame, "SUM(amount)", "kind").first()["concentration"] == 0


def test_more_segments_than_shown(spark):
    frame = spark.range(300).select(F.col("id").cast("string").alias("kind"), F.lit(1).alias("amount"))
    whole = segments.segment_summary(frame, "SUM(amount)", "kind").first()
    assert (whole["segments"], whole["total"]) == (300, 300)
    assert whole["long_tail_share"] == pytest.approx(290 / 300)
    assert segments.top_concentration(frame, "SUM(amount)", "kind").first()["top_share"] == pytest.approx(1 / 300)
    for split in (None, 50):
        ranked = segments.segment_ranking(frame, "SUM(amount)", "kind", max_group_rows=split)
        assert sorted(row["place"] for row in ranked.collect()) == list(range(1, 301))
        assert dict(ranked.dtypes)["place"] == "bigint"
    assert segments.segment_ranking(frame, "SUM(amount)", "kind", max_segments=3).count() == 3


def test_the_newest_of_many_periods_is_last(spark):
    days = spark.range(7300).select(
        F.date_add(F.lit("2005-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.col("id").alias("amount")
    )
    values = series.period_values(days, "SUM(amount)", "day", "day")
    summary = series.trend_summary(values).first()
    assert (summary["periods"], summary["last_value"]) == (7300, 7299)
    assert series.anomaly_scores(values).count() == 7300


def test_many_measures_and_dimensions_are_all_analysed(spark):
    wide = spark.range(50).select(
        *[(F.col("id") % (n + 2)).alias(f"m{n}") for n in range(20)],
        *[(F.col("id") % (n + 2)).cast("string").alias(f"d{n}") for n in range(12)],
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"),
    )
    columns = profile.column_profile(wide)
    assert semantic.metrics_from_profile(columns).count() == 20
    model = semantic.build_semantic_model("wide", "wide", columns)
    assert [item.column for item in model.dimensions] == [f"d{n}" for n in range(12)] + ["day"]
    assert len(plan_tasks("executive_summary", model)) == 1 + 20 + 13 + 1
    assert len(plan_tasks("deep_dive", model)) == 1 + 40 + 13 + 1
    order = [task.module for task in plan_tasks("diagnostic", model)]
    assert order == ["trends"] * 20 + ["diagnostics"] + ["anomalies"] * 20
    assert diagnostics.instability(wide, "day", [f"d{n}" for n in range(12)]).count() == 12


def test_impact_of_unstable_categories(spark):
    rows = [(f"2024-01-{day:02d}", str(day)) for day in range(1, 5)] + [("2024-02-01", "1")]
    frame = spark.createDataFrame(rows, "day string, kind string").withColumn("day", F.col("day").cast("date"))
    model = SemanticModel("t", "t", (), (Dimension("kind", "kind"),), (), "day")
    facts, _ = modules.diagnostics_module(frame, model, 1)
    found = {row["kind"]: row["impact_score"] for row in facts.collect()}
    assert found["instability"] == pytest.approx(0.8)


def test_nested_columns(spark):
    frame = spark.createDataFrame([([1.0], {"a": 1}, 2)], "vector array<double>, tags map<string,int>, n int")
    rows = {row["column"]: row for row in profile.column_profile(frame).collect()}
    assert (rows["vector"]["role"], rows["tags"]["role"]) == ("unknown", "unknown")
    assert rows["vector"]["distinct_count"] is None
    assert profile.profile_dataset("nested", frame).table().count() == 3


def test_odd_column_names(spark):
    frame = spark.createDataFrame([(1, "x", None)], "`a b` int, `c.d` string, `e``f` string")
    assert profile.profile_dataset("odd", frame).table().count() == 3
    assert diagnostics.missingness(frame).filter("null_rate = 1").first()["column"] == "e`f"
    with pytest.raises(ValueError, match="Unsafe metric"):
        run_analysis("odd", frame)
    assert run_analysis("odd", frame.drop("a b")).ranked.count() > 0


def test_missing_and_duplicates(spark):
    rows = [(i % 5, None if i % 2 else "x", f"u{i}") for i in range(30)]
    frame = spark.createDataFrame(rows, "item_id int, gap string, name string")
    found = {row["title"]: row for row in run_analysis("bad", frame, mode="overview").ranked.collect()}
    assert found["Data missingness risk"]["observation"].startswith("Highest null-rate columns: gap (50.0%), ")
    duplicates = found["Suspicious duplicates on key candidate"]
    assert duplicates["observation"] == "Found 25 duplicate rows for key candidate item_id."
    assert "No critical diagnostics alerts" not in found


def test_null_keys_count_as_duplicates(spark):
    frame = spark.createDataFrame([(1,), (None,), (None,)], "id int")
    assert diagnostics.duplicate_keys(frame).first()["duplicate_count"] == 2


def test_instability_without_values(spark):
    frame = table(spark, [("2024-01-01", None, 1, None), ("2024-02-01", "a", 1, None), ("2024-02-02", "b", 1, None)])
    row = diagnostics.instability(frame, "day", ["kind"]).first()
    assert (row["max_count"], row["min_count"], row["explosion_ratio"]) == (2, 0, 2.0)


def test_approximate_counts(spark):
    frame = spark.range(2000).select(
        (F.col("id") % 1900).alias("many"),
        (F.col("id") % 3).cast("string").alias("few"),
        F.lit("2024-01-01").cast("date").alias("day"),
    )
    exact = diagnostics.cardinality(frame, ["many", "few"]).orderBy("ordinal").collect()
    rough = diagnostics.cardinality(frame, ["many", "few"], approx=True).orderBy("ordinal").collect()
    assert [row["distinct_count"] for row in exact] == [1900, 3]
    assert rough[1]["distinct_count"] == 3
    assert abs(rough[0]["distinct_count"] - 1900) < 250
    months = diagnostics.instability(frame, "day", ["few"], approx=True).first()
    assert months["explosion_ratio"] == 1.0
    assert run_analysis("rough", frame, approx=True).ranked.count() > 0


def test_rounded_halves(spark):
    row = spark.range(1).selectExpr(
        f"{percent_sql('0.0625D')} AS a", f"{percent_sql('0.1875D')} AS b", f"{fixed_sql('0.125D', 2)} AS c"
    ).first()
    assert tuple(row) == (f"{0.0625:.1%}", f"{0.1875:.1%}", f"{0.125:.2f}")


def test_plain_numbers(spark):
    values = [0.0, -1.5, 15309876.0, 1e15, 0.0001, 123456.789, 1234567890.125, -98765432.1]
    frame = spark.createDataFrame([(value,) for value in values], "v double")
    assert [row[0] for row in frame.select(plain_number(F.col("v"))).collect()] == [repr(value) for value in values]
