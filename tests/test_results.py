"""Insights, charts, notes, micro-batches and plan shapes."""

from __future__ import annotations

import contextlib
import io
import re
from pathlib import Path

import pytest
from conftest import SF_DIR, load
from pyspark.sql import functions as F

from registry.queries import QUERIES
from tallyline.operators import conversation, interpret, series


def insight(frame, *names, **options):
    return interpret.top_insight(frame, "q", *names, **options).first()


def test_insight(spark):
    frame = spark.createDataFrame([("Acme", 120.0), ("Blue Harbor", 175.0)], "customer_name string, revenue double")
    row = insight(frame, ["revenue"], ["customer_name"], duration_ms=3)
    assert row["insight"] == (
        "Answer to 'q': returned 2 rows in 3 ms. Top insight: customer_name=Blue Harbor leads on revenue with 175.0. "
        "Result preview represents full returned rows."
    )
    assert "may be truncated" in insight(frame, truncated=True)["insight"]


def test_insight_without_numbers(spark):
    frame = spark.createDataFrame([("North",), ("South",)], "region string")
    assert "non-numeric" in insight(frame)["insight"]
    assert insight(frame.limit(0))["insight"] == "No rows returned for question: q"


def test_insight_skips_empty_metric(spark):
    rows = [(None, 3, "a"), (None, 9, None), (None, 9, "c")]
    frame = spark.createDataFrame(rows, "total_x int, other int, name string").coalesce(1)
    row = insight(frame)
    assert (row["top_metric"], row["metric_value"], row["dimension_label"]) == ("other", 9.0, "top row")
    big = spark.range(100).select(F.col("id").alias("total"), F.concat(F.lit("n"), "id").alias("name")).coalesce(1)
    assert insight(big)["dimension_label"] == "name=n99"
    assert insight(big, preview_rows=8)["dimension_label"] == "name=n7"


def test_chart(spark):
    assert interpret.chart_hint(["a", "b"], False) is None
    assert interpret.chart_hint(["order_date", "b"], True) == "line"
    assert interpret.chart_hint(["a", "b"], True) == "bar"
    assert interpret.chart_hint(["a", "b", "c"], True) == "table"
    assert interpret.chart_hint(["a"], True) is None
    frame = spark.createDataFrame([(1, 2, "x")], "n int, m int, ship_date string")
    assert tuple(interpret.chart_series(frame).first()) == ("line", "x", 1.0)
    assert interpret.chart_axes(frame, "table") == ("n", "m")
    assert interpret.chart_series(frame.select("ship_date", F.lit("y").alias("z"))).count() == 0


def test_note_files(spark, tmp_path):
    rows = [
        ("team review", 1, "show one row", "done", "query", "SELECT 1 AS ok", "2024-01-01"),
        ("team review", 2, "hello", "hi", "chat", None, "2024-01-02"),
        ("..", 1, "x", "y", "chat", "", "2024-01-01"),
    ]
    turns = spark.createDataFrame(
        rows, "session string, seq int, user string, assistant string, mode string, sql string, at string"
    )
    notes = conversation.conversation_notes(turns, sql="sql", at="at")
    assert {row["file_name"] for row in notes.collect()} == {"team_review.md", "default.md"}
    path = tmp_path / "notes"
    conversation.write_notes(notes, str(path))
    parts = sorted((path / "file_name=team_review.md").glob("part-*"))
    assert "".join(part.read_text() for part in parts) == (
        "# Conversation Notes: team review\n\n_Created: 2024-01-01_\n\n"
        "## Turn (2024-01-01)\n\n- Mode: `query`\n- User: show one row\n\n### Assistant\n\ndone\n\n"
        "### SQL\n\n```sql\nSELECT 1 AS ok\n```\n\n"
        "## Turn (2024-01-02)\n\n- Mode: `chat`\n- User: hello\n\n### Assistant\n\nhi\n\n"
    )


def test_replies(spark):
    rows = [("s", 1, "hello"), ("s", 2, "show sql"), ("s", 3, "show rows"), ("s", 4, "show sql"), ("s", 5, "thanks")]
    frame = spark.createDataFrame(rows, "session string, seq int, text string")
    replies = [row["reply"] for row in conversation.previous_queries(frame).orderBy("seq").collect()]
    assert replies == [
        conversation.FIRST_CHAT.format(hint=conversation.NO_HINT),
        conversation.NO_PREVIOUS_SQL,
        None,
        conversation.PREVIOUS_SQL,
        conversation.NEXT_CHAT,
    ]


def test_hints_and_suggestions(spark):
    assert conversation.semantic_hint() == "No semantic metadata loaded."
    hint = conversation.semantic_hint(["m1", "m2", "m3", "m4", "m5"], ["d"], ["v"])
    assert hint == "Preferred views: v. Metrics: m1, m2, m3, m4. Dimensions: d."
    log = spark.createDataFrame([("s", 1, "hello")], "session string, seq int, text string")
    assert conversation.previous_queries(log, hint=hint).first()["reply"].endswith(hint)
    rows = [("a.", 2, ["m2", "x"], "{1}"), ("b.", 0, ["m2"], "{1}"), (None, None, None, None)]
    results = spark.createDataFrame(rows, "summary string, row_count int, columns array<string>, first_row string").coalesce(1)
    reply = lambda *names: [row["reply"] for row in conversation.query_replies(results, *names).collect()]
    assert reply(["m1", "m2"], ["d"])[0].endswith("{1} Suggested follow-ups: break down m2 by d; compare m2 vs previous period")
    assert reply(["m1"])[2] == " Suggested follow-ups: compare m1 vs previous period"
    assert reply()[0] == "a. First row preview: {1} Suggested follow-ups: ask for a trend over time"
    assert reply()[1] == conversation.NO_RESULT_ROWS


def plan(frame) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain("formatted")
    return text.getvalue()


def test_scans_read_only_what_they_need(spark):
    weeks = series.period_values(
        load(spark, "lineitem").filter("l_shipdate >= timestamp_ntz'1996-01-01'"), "SUM(l_quantity)", "l_shipdate", "week"
    )
    text = plan(weeks)
    assert "ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>" in text
    assert "GreaterThanOrEqual(l_shipdate" in text
    assert text.count("Exchange") <= 3


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"ingest_csv", "ingest_parquet", "saved_evidence"}))
def test_no_cross_joins_or_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|InPandas", text)


def test_keyed_limits_run_before_the_shuffle(spark):
    text = plan(QUERIES["segment_by_flag"](spark, SF_DIR))
    assert text.index("WindowGroupLimit") and "Partial" in text


def test_no_local_checkpoints():
    root = Path(__file__).resolve().parent.parent
    for path in [*root.glob("tallyline/**/*.py"), *root.glob("registry/*.py")]:
        assert "localCheckpoint" not in path.read_text(), path
