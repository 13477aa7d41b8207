"""The whole way from a file to an answer."""

from __future__ import annotations

import pytest
from conftest import SF_DIR

from tallyline.models import SemanticConfig
from tallyline.plans.guarded import UnsafeQuery
from tallyline.plans.workspace import Workspace


@pytest.fixture(scope="module")
def workspace(spark, sales_csv, tmp_path_factory):
    workspace = Workspace(spark, str(tmp_path_factory.mktemp("workspace")))
    workspace.load_csv(sales_csv, "Sales", "raw sales")
    return workspace


def test_load(workspace, sales_csv):
    entry = workspace.catalog.get("sales")
    assert (entry.table_name, entry.row_count) == ("raw_sales", 14)
    with pytest.raises(ValueError, match="exists"):
        workspace.load_csv(sales_csv, "sales")
    workspace.load_parquet(f"{SF_DIR}/nation.parquet", "nation")
    workspace.load_parquet(f"{SF_DIR}/nation.parquet", "nation", replace=True)
    assert [row["dataset_name"] for row in workspace.catalog.list().collect()] == ["nation", "sales"]
    with pytest.raises(KeyError):
        workspace.table("unknown")


def test_preview(workspace):
    seen = workspace.preview("sales", 3)
    assert (seen.rows.count(), seen.row_count, len(seen.columns)) == (3, 14, 7)


def test_analysis(workspace, spark):
    with pytest.raises(ValueError, match="no semantic model"):
        workspace.explain_metric("sales", "total_revenue")
    assert workspace.profile("sales").row_count == 14
    model = workspace.build_model("sales", "retail")
    assert workspace.model("sales") == model
    assert workspace.explain_metric("sales", "total_revenue").first()["sql"] == "SUM(revenue)"
    report = workspace.analyse("sales", "Give me top trends and risks")
    assert report.summary.first()["headline"] == "Headline metric: total_revenue"
    entry = workspace.catalog.get("sales")
    assert entry.profile_path.endswith("/profiles/sales")
    assert entry.semantic_path.endswith("/semantics/sales")
    again = Workspace(spark, workspace.root)
    assert again.analyse("sales", mode="overview").findings.count() > 0


def test_ask(workspace):
    sql = "SELECT customer_name, SUM(revenue) AS total_revenue FROM raw_sales GROUP BY 1 ORDER BY 2 DESC"
    found = workspace.ask("sales", "Who buys most?", sql)
    assert found.result.sql == sql
    assert "Top insight: customer_name=Quill leads on total_revenue with 1465." in found.summary
    assert (found.chart, len(found.rows)) == ("bar", 5)
    assert found.reply == (
        f"{found.summary} First row preview: {{'customer_name': 'Quill', 'total_revenue': 1465}}"
        " Suggested follow-ups: break down total_revenue by customer_name; compare total_revenue vs previous period"
    )
    dated = workspace.ask("sales", "When?", "SELECT order_date, region, units FROM sales WHERE units > 100")
    assert (dated.summary, dated.chart) == ("No rows returned for question: When?", None)
    assert dated.reply == "I ran the query successfully, but it returned no rows."
    with pytest.raises(UnsafeQuery):
        workspace.ask("sales", "?", "SELECT * FROM nation")


def test_converse(workspace, spark):
    log = spark.createDataFrame([("a", 1, "hello"), ("a", 2, "top regions"), ("a", 3, "thanks")], "session string, seq int, text string")
    config = SemanticConfig(preferred_views=("v_orders", "v_items"))
    replies = {row["seq"]: row["reply"] for row in workspace.converse("sales", log, config).collect()}
    names = [metric.name for metric in workspace.model("sales").metrics][:4]
    assert f"Preferred views: v_orders, v_items. Metrics: {', '.join(names)}. Dimensions: " in replies[1]
    assert replies[2] is None and replies[3].startswith("I can continue")
    workspace.load_parquet(f"{SF_DIR}/region.parquet", "region")
    assert workspace.hint("region") == "No semantic metadata loaded."
