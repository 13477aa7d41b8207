"""A small table of sales: every part of an analysis against plain Python over the same rows."""

from __future__ import annotations

import csv
import io
import statistics
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest
from conftest import SALES
from pyspark.sql import functions as F

from tallyline.models import SemanticConfig
from tallyline.operators import diagnostics, findings, profile, segments, semantic, series
from tallyline.plans.report import run_analysis
from tallyline.plans.tasks import plan_tasks


ROWS = [
    row | {"order_date": date.fromisoformat(row["order_date"]), "revenue": int(row["revenue"]), "units": int(row["units"])}
    for row in csv.DictReader(io.StringIO(SALES))
]
REVENUE, UNITS = ([row[name] for row in ROWS] for name in ("revenue", "units"))


def totals(key, value="revenue"):
    """Sums by a key, the keys in order."""
    found = defaultdict(int)
    for row in ROWS:
        found[key(row)] += row[value]
    return dict(sorted(found.items()))


def month(row):
    return row["order_date"].replace(day=1)


def week(row):
    return row["order_date"] - timedelta(days=row["order_date"].weekday())


def largest_first(name):
    return sorted(totals(lambda row: row[name]).items(), key=lambda entry: -entry[1])


def z_scores(values):
    mean, deviation = statistics.mean(values), statistics.pstdev(values)
    return [(value - mean) / deviation for value in values]


def mad_scores(values):
    middle = statistics.median(values)
    spread = statistics.median(abs(value - middle) for value in values)
    return [0.6745 * (value - middle) / spread for value in values]


def changes(values):
    return [b - a for a, b in zip(values, values[1:], strict=False)]


@pytest.fixture(scope="module")
def model(sales):
    return semantic.build_semantic_model("sales", "sales", profile.column_profile(sales))


def test_roles(sales):
    roles = {row["column"]: row["role"] for row in profile.column_profile(sales).collect()}
    assert roles == {
        "order_id": "id",
        "order_date": "time",
        "customer_name": "dimension",
        "region": "dimension",
        "category": "dimension",
        "revenue": "measure",
        "units": "measure",
    }


def test_numeric_profile(sales):
    rows = {row["column"]: row for row in profile.numeric_profile(sales).collect()}
    for name, values in (("revenue", REVENUE), ("units", UNITS)):
        found = [rows[name][k] for k in ("min", "max", "median", "mean", "stddev")]
        known = (min(values), max(values), statistics.median(values), statistics.mean(values), statistics.stdev(values))
        assert found == pytest.approx(known)


def test_dataset_profile(sales):
    found = profile.profile_dataset("sales", sales)
    assert found.row_count == len(ROWS)
    rows = {row["column"]: row for row in found.table().collect()}
    counts = Counter(row["customer_name"] for row in ROWS)
    known = sorted(counts.items(), key=lambda entry: (-entry[1], entry[0]))[:5]
    assert [tuple(top) for top in rows["customer_name"]["top_values"]] == known
    assert str(rows["order_date"]["date_max"]) == "2023-07-25 00:00:00"


def test_model(model):
    assert [metric.name for metric in model.metrics] == ["total_revenue", "total_units"]
    assert [d.name for d in model.dimensions] == ["customer_name", "region", "category", "order_date"]
    assert model.preferred_time_dimension == "order_date"
    assert semantic.SemanticModel.from_dict(model.to_dict()) == model


def test_months(sales):
    values = list(totals(month).values())
    months = series.period_values(sales, "SUM(revenue)", "order_date", "month")
    assert [row["value"] for row in months.orderBy("period").collect()] == values
    deltas = series.trend_deltas(months).orderBy("period").collect()
    assert [row["delta"] for row in deltas] == changes(values)
    summary = series.trend_summary(months).first()
    assert summary["volatility_ratio"] == pytest.approx(statistics.pstdev(values) / statistics.mean(values))
    assert (summary["max_increase"], summary["max_decrease"]) == (max(changes(values)), min(changes(values)))
    assert summary["spikes"] == sum(abs(z) >= 2 for z in z_scores(values))
    scores = [row["z_score"] for row in series.anomaly_scores(months).orderBy("period").collect()]
    assert scores == pytest.approx(z_scores(values))


def test_weeks(sales):
    known = totals(week)
    weeks = series.period_values(sales, "SUM(revenue)", "order_date", "week")
    assert {row["period"].date(): row["value"] for row in weeks.collect()} == known
    scores = series.anomaly_scores(weeks).orderBy("period").collect()
    values = list(known.values())
    assert [row["z_score"] for row in scores] == pytest.approx(z_scores(values))
    assert [row["mad_score"] for row in scores] == pytest.approx(mad_scores(values))
    odd = [abs(z) >= 2.5 or abs(m) >= 3.5 for z, m in zip(z_scores(values), mad_scores(values), strict=True)]
    assert series.anomaly_flags(weeks).count() == sum(odd) == 0


@pytest.mark.parametrize("dimension", ["customer_name", "region", "category"])
def test_segments(sales, dimension):
    known = largest_first(dimension)
    ranked = segments.segment_ranking(sales, "SUM(revenue)", dimension).orderBy("place").collect()
    assert [(row["segment"], row["value"]) for row in ranked] == known
    share = segments.top_concentration(sales, "SUM(revenue)", dimension).first()["top_share"]
    assert share == pytest.approx(known[0][1] / sum(REVENUE))
    summary = segments.segment_summary(sales, "SUM(revenue)", dimension).first()
    assert summary["concentration"] == pytest.approx(sum((value / sum(REVENUE)) ** 2 for _, value in known))
    assert summary["spread"] == known[0][1] - known[-1][1]
    assert summary["long_tail_share"] == 0


def test_instability_and_keys(sales):
    ratios = diagnostics.instability(sales, "order_date", ["customer_name", "category"]).collect()
    for row in ratios:
        counts = [len({r[row["dimension"]] for r in ROWS if month(r) == period}) for period in totals(month)]
        assert row["explosion_ratio"] == max(counts) / min(counts)
    assert len(ratios) == 2
    keys = diagnostics.duplicate_keys(sales).first()
    assert (keys["key"], keys["duplicate_count"]) == ("order_id", 0)


def test_task_lists(model):
    def short(mode):
        return [(t.module, t.metric, t.dimension, t.grain, t.priority) for t in plan_tasks(mode, model)]

    assert short("executive_summary") == [
        ("overview", None, None, None, 1),
        ("trends", "total_revenue", None, "month", 2),
        ("trends", "total_units", None, "month", 3),
        ("segments", "total_revenue", "customer_name", None, 4),
        ("segments", "total_revenue", "region", None, 5),
        ("segments", "total_revenue", "category", None, 6),
        ("segments", "total_revenue", "order_date", None, 7),
        ("diagnostics", None, None, None, 8),
    ]
    assert [(m, p) for m, _, _, _, p in short("diagnostic")] == [
        ("trends", 1),
        ("trends", 2),
        ("diagnostics", 5),
        ("anomalies", 11),
        ("anomalies", 12),
    ]
    assert [m for m, *_ in short("deep_dive")] == [
        "overview",
        "trends",
        "anomalies",
        "trends",
        "anomalies",
        "segments",
        "segments",
        "segments",
        "segments",
        "diagnostics",
    ]
    assert short("overview") == [("overview", None, None, None, 1), ("diagnostics", None, None, None, 2)]
    with pytest.raises(ValueError, match="Unsupported analysis mode"):
        plan_tasks("guess", model)


def test_report(sales):
    report = run_analysis("sales", sales, "Give me top trends and risks")
    ranked = report.ranked.orderBy("rank").collect()
    assert len(ranked) == 27
    titles = [row["title"] for row in ranked]
    assert titles[0].startswith("Headline metric: total_")
    scores = [row["combined_score"] for row in ranked]
    assert scores == sorted(scores, reverse=True)
    observations = {row["observation"] for row in ranked}
    months = totals(month)
    fall = min(zip(changes(list(months.values())), list(months)[1:], strict=True))
    (first, most), *_, (last, least) = largest_first("customer_name")
    ratio = statistics.pstdev(months.values()) / statistics.mean(months.values())
    index = sum((value / sum(REVENUE)) ** 2 for _, value in largest_first("customer_name"))
    for text in (
        f"Current aggregate value for total_revenue is {sum(REVENUE)}",
        f"{first} leads total_revenue with value {most}",
        f"Largest period decline is {fall[0]:.2f} on {fall[1]} 00:00:00",
        f"Volatility ratio is {ratio:.2f} at month grain",
        f"HHI-style concentration index is {index:.3f}",
        f"Top segment {first} exceeds tail segment {last} by {most - least:.2f}.",
        f"Top customer_name segment contributes {most / sum(REVENUE):.1%} of top-10 visible total_revenue.",
        "Data spans from 2023-04-04 00:00:00 to 2023-07-25 00:00:00",
        "Long-tail share outside top 10 is 0.0%",
    ):
        assert text in observations

    summary = report.summary.first()
    assert summary["headline"] == titles[0]
    assert summary["top_findings"] == [row["title"] for row in ranked[:3]]
    assert summary["key_risks"] == [row["observation"] for row in ranked if row["severity"] == "high"][:3]
    assert summary["follow_up_questions"] == [f"Validate drivers behind: {row['title']}" for row in ranked[:2]]
    assert [row["title"] for row in report.top_findings.orderBy("rank").collect()] == summary["top_findings"]

    assert [tuple(row) for row in report.plan.collect()][1] == ("trends", "total_revenue", None, "month", 2)
    assert set(report.raw_outputs) == {
        "overview:1",
        "trends:2",
        "trends:3",
        "segments:4",
        "segments:5",
        "segments:6",
        "segments:7",
        "diagnostics:8",
    }
    for outputs in report.raw_outputs.values():
        for make in outputs.values():
            make().collect()
    deltas = report.raw_outputs["trends:3"]["deltas"]().orderBy("period").collect()
    assert [row["delta"] for row in deltas] == changes(list(totals(month, "units").values()))


def test_quiet_anomalies(sales):
    ranked = run_analysis("sales", sales, mode="diagnostic").ranked.collect()
    quiet = [row["title"] for row in ranked if row["title"].startswith("No strong anomaly")]
    assert sorted(quiet) == [
        "No strong anomaly signals for total_revenue",
        "No strong anomaly signals for total_units",
    ]


def test_model_from_config(sales):
    config = SemanticConfig.from_dict(
        {
            "project": "demo",
            "metrics": [{"name": "revenue", "expression": "SUM(revenue)"}, {"name": "noted", "description": "x"}],
            "dimensions": [{"name": "order_date"}, {"name": "region"}],
            "business_rules": ["Use the sales view"],
        }
    )
    model = semantic.model_from_config("sales", "sales", config, "order_date")
    assert [metric.name for metric in model.metrics] == ["revenue"]
    report = run_analysis("sales", sales, model=model, mode="overview")
    assert "Headline metric: revenue" in {row["title"] for row in report.ranked.collect()}


def test_validation(sales, model):
    assert semantic.validate_model(sales, model) is model
    broken = {
        "metrics": [
            {"name": "a", "sql": "SUM(revenue) + 1"},
            {"name": "b", "sql": "SUM(nothing)"},
            {"name": "c", "sql": "sum( revenue )"},
            {"name": "d", "sql": "SUM(*)"},
        ],
        "dimensions": [{"name": "x", "column": "missing"}],
        "business_rules": ["Prefer total_profit by dim_x, not dim_y"],
        "preferred_time_dimension": "day",
    }
    bad = semantic.SemanticModel.from_dict({**model.to_dict(), **broken})
    with pytest.raises(ValueError) as error:
        semantic.validate_model(sales, bad)
    message = str(error.value)
    for part in ("unsafe_metric: a", "unsafe_metric: d", "unknown_metric_column: b", "unknown_dimension_column: x"):
        assert part in message
    for part in ("unknown_time_column: day", "reference: total_profit", "reference: dim_y"):
        assert part in message
    assert "dim_x" not in message.split("reference: ", 1)[0]


def test_explain_metric(sales, model):
    row = semantic.explain_metric(sales, model, "total_units").first()
    assert row["sql"] == "SUM(units)"
    assert row["dimensions_commonly_used"] == ["customer_name", "region", "category"]
    with pytest.raises(ValueError, match="Unknown metric"):
        semantic.explain_metric(sales, model, "total_profit")


def test_scored_example(spark):
    """Two findings whose scores are known: 0.81 is high, 0.485 is medium."""
    rows = [
        ("d", 1, 0, "Low", "small", None, 0.2, 0.9, 0.4, "low", [], ["x"]),
        ("d", 2, 0, "High", "large", None, 0.9, 0.7, 0.8, "low", [], ["x"]),
    ]
    frame = spark.createDataFrame(
        rows,
        "dataset_name string, task_no int, finding_no int, title string, observation string, metric string, "
        "impact_score double, confidence_score double, business_relevance_score double, severity string, "
        "caveats array<string>, evidence array<string>",
    )
    ranked = findings.rank_findings(frame).orderBy("rank").collect()
    assert [(row["title"], row["severity"]) for row in ranked] == [("High", "high"), ("Low", "medium")]
    assert [row["combined_score"] for row in ranked] == pytest.approx([0.81, 0.485])


EQUAL_SCORES = "dataset_name string, task_no int, finding_no int, title string, observation string, metric string, " \
    "impact_score double, confidence_score double, business_relevance_score double, severity string, " \
    "caveats array<string>, evidence array<string>"


def test_equal_scores_keep_report_order(spark):
    """0.395, 0.85 and 0.92 each come twice; as sums of doubles the second of a pair is the larger one."""
    scores = [(0.09, 0.67, 0.6), (0.3, 0.4, 0.6), (1.0, 0.8, 0.6), (1.0, 0.6, 0.95), (1.0, 0.8, 0.95), (1.0, 1.0, 0.6)]
    rows = [("d", i, 0, f"t{i}", "small", None, *three, "low", [], ["x"]) for i, three in enumerate(scores)]
    ranked = findings.rank_findings(spark.createDataFrame(rows, EQUAL_SCORES)).orderBy("rank").collect()
    assert [row["title"] for row in ranked] == ["t4", "t5", "t2", "t3", "t0", "t1"]
    assert [row["combined_score"] for row in ranked] == [0.92, 0.92, 0.85, 0.85, 0.395, 0.395]
    assert [row["severity"] for row in ranked] == ["high"] * 4 + ["low"] * 2


def test_summary_of_equal_scores(spark):
    """The second finding derives the confidence that the first is given, 0.24, from two caveats and no evidence."""
    rows = [
        ("d", 0, 0, "Given", "small", None, 0.5, 0.24, 0.6, "low", ["a"], []),
        ("d", 1, 0, "Derived", "small", None, 0.5, 0.0, 0.6, "low", ["b", "c"], []),
    ]
    frame = spark.createDataFrame(rows, EQUAL_SCORES)
    assert [row["confidence_score"] for row in findings.score_findings(frame).collect()] == [0.24, 0.24]
    row = findings.executive_summary(frame).first()
    assert (row["headline"], row["top_findings"]) == ("Given", ["Given", "Derived"])
    assert row["caveats"] == ["a", "b", "c"]
    assert row["follow_up_questions"][0] == "Validate drivers behind: Given"


def test_default_summary(spark, sales):
    none = run_analysis("sales", sales, mode="overview").findings.filter(F.lit(False))
    row = findings.summary_or_default(none, "sales").first()
    assert row["headline"] == "No material findings"
    assert row["caveats"] == ["Summary is constrained to deterministic evidence only."]
    assert row["follow_up_questions"] == ["Collect more data to produce actionable findings."]


def scans(frame) -> int:
    """Scans of the plan that ran, those of reused stages left out."""
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    final = text[text.index("== Final Plan ==") : text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    return final.count("FileScan")


def test_scans_do_not_follow_the_number_of_dimensions(spark, tmp_path):
    counts = []
    for width in (1, 3, 12):
        wide = spark.range(200).select(
            (F.col("id") % 5 * 1.5).alias("revenue"),
            F.expr("date_add(DATE '2024-01-01', int(id % 90))").alias("day"),
            *[(F.col("id") % (n + 2)).cast("string").alias(f"kind{n}") for n in range(width)],
            (F.col("id") % 2 == 0).alias("flag"),
        )
        path = str(tmp_path / f"wide{width}")
        wide.write.parquet(path)
        report = run_analysis("wide", spark.read.parquet(path), mode="executive_summary")
        assert sum(task.module == "segments" for task in report.tasks) == width + 2
        counts.append(scans(report.findings))
    assert counts[0] == counts[1] == counts[2] <= 5


def test_summaries_of_many_dimensions_are_those_of_each(spark):
    rows = [("b", 9, True, 2.0, None), ("b", 10, None, 2.0, 5), (None, 9, True, None, 7), ("a", 10, False, 4.0, 5), ("key", 11, False, -1.0, 5)]
    frame = spark.createDataFrame(rows, "key string, size int, flag boolean, revenue double, key0 int")
    names = ["key", "size", "flag", "key0"]
    found = {row["ordinal"]: row.asDict() for row in segments.segment_summaries(frame, "SUM(revenue)", names).collect()}
    for number, name in enumerate(names):
        single = segments.segment_summary(frame, "SUM(revenue)", name).first().asDict()
        assert {k: v for k, v in found[number].items() if k != "ordinal"} == single
        top = segments.top_concentration(frame, "SUM(revenue)", name).first()
        assert (single["top_share"], single["top_severity"]) == (top["top_share"], top["severity"])
    assert segments.segment_summaries(frame.limit(0), "SUM(revenue)", names).count() == 0


def test_grains_rolled_up_from_days_are_those_of_the_rows(spark):
    rows = spark.range(900).select(
        F.expr("IF(id % 50 = 0, NULL, date_add(DATE '2023-11-20', int(id * 7 % 450)))").alias("day"),
        F.expr("IF(id % 11 = 0, NULL, int(id % 37) - 9)").alias("units"),
        F.expr("IF(id % 13 = 0, NULL, CAST(id % 101 / 7 AS DECIMAL(12,3)))").alias("price"),
        F.expr("IF(id % 450 < 100, NULL, id % 8 * 0.5D)").alias("weight"),
        F.expr("CAST(id % 3 AS STRING)").alias("kind"),
    )
    names = ["units", "price", "weight"]
    metrics = {f"{f}_{n}": f"{f}({n})" for f in ("SUM", "AVG", "MIN", "MAX", "COUNT") for n in names} | {"n": "COUNT(*)"}
    for by in ((), ("kind",)):
        states = series.daily_states(rows, metrics, "day", by)
        assert len(states.days.columns) < len(metrics) + 4
        for grain in series.TREND_GRAINS:
            wanted = series.metric_series(rows, metrics, "day", grain, by)
            found = states.roll_up(grain)
            assert found.columns == wanted.columns
            key = [*by, "period"]
            left = {tuple(row[k] for k in key): row.asDict() for row in found.collect()}
            right = {tuple(row[k] for k in key): row.asDict() for row in wanted.collect()}
            assert left == right
    assert series.daily_states(rows.limit(0), metrics, "day").roll_up("week").count() == 0
    with pytest.raises(ValueError, match="Unsupported grain"):
        states.roll_up("quarter", series.ANOMALY_GRAINS)


def test_all_series_of_a_report_share_one_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(400).select(
        F.expr("id % 9 * 1.5D").alias("revenue"),
        F.expr("int(id % 5)").alias("units"),
        F.expr("date_add(DATE '2024-01-01', int(id % 200))").alias("day"),
        F.expr("CAST(id % 4 AS STRING)").alias("kind"),
    ).write.parquet(path)
    one = run_analysis("rows", spark.read.parquet(path), mode="executive_summary")
    deep = run_analysis("rows", spark.read.parquet(path), mode="deep_dive")
    assert {task.grain for task in deep.tasks if task.grain} == {"week", "month"}
    assert scans(deep.findings) == scans(one.findings)
