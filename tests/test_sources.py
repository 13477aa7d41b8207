"""Files, catalog, saved results, JDBC options."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from conftest import load
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.small import small_table
from tallyline.functions.text import clean_name, clean_name_column
from tallyline.models import DATASET_SCHEMA
from tallyline.operators import conversation
from tallyline.operators.profile import column_profile, profile_dataset
from tallyline.operators.semantic import build_semantic_model
from tallyline.plans.report import run_analysis
from tallyline.session import scratch_path, shared_folder
from tallyline.sources import describe, ingest, jdbc, store
from tallyline.sources.catalog import DatasetCatalog, RegisteredDataset

NAMES = {
    "Sales 2024!": "sales_2024",
    "2024 sales": "t_2024_sales",
    "  __a--b__ ": "a_b",
    "???": "dataset",
    "Ünï": "n",
}


def test_names(spark):
    assert {name: clean_name(name) for name in NAMES} == NAMES
    rows = spark.createDataFrame([(name,) for name in NAMES], "name string")
    found = rows.select("name", clean_name_column(F.col("name")).alias("clean")).collect()
    assert {row["name"]: row["clean"] for row in found} == NAMES


def test_csv(spark, sales_csv, tmp_path):
    result = ingest.ingest_csv(
        spark, sales_csv, "Sales 2025", replace=True, dataset="sales", location=str(tmp_path / "sales")
    )
    assert (result.dataset_name, result.table_name, result.row_count) == ("sales", "sales_2025", 14)
    assert dict(spark.table("sales").dtypes)["order_date"] == "date"
    with pytest.raises(AnalysisException):
        ingest.ingest_csv(spark, sales_csv, "Sales 2025", location=str(tmp_path / "again"))
    again = ingest.ingest_csv(spark, sales_csv, "Sales 2025", replace=True, location=str(tmp_path / "new"))
    assert (again.row_count, again.dataset_name) == (14, "sales_2025")
    typed = ingest.ingest_csv(
        spark,
        sales_csv,
        "typed",
        replace=True,
        schema="order_id long, order_date string, customer_name string, region string, category string, "
        "revenue double, units long",
        location=str(tmp_path / "typed"),
    )
    assert typed.schema["revenue"].dataType == T.DoubleType()


def test_missing_file(spark):
    with pytest.raises(FileNotFoundError):
        ingest.ingest_csv(spark, "/nowhere/x.csv", "x")
    with pytest.raises(FileNotFoundError):
        ingest.ingest_parquet(spark, "/nowhere/x.parquet", "x")


def test_describe(spark, sales):
    rows = {row["column"]: row for row in describe.describe_table(sales).collect()}
    assert rows["customer_name"]["samples"] == ["Linden", "Moss", "Quill"]
    assert rows["order_id"]["samples"] == ["1", "10", "11"]
    two = spark.createDataFrame([("x", None), ("x", None)], "a string, b int")
    assert [row["samples"] for row in describe.describe_table(two).collect()] == [["x"], []]


def test_preview(spark, sales):
    seen = describe.preview(sales, 5, ["order_id"])
    assert (seen.row_count, seen.truncated, seen.rows.count()) == (14, True, 5)
    assert seen.rows.first()["order_date"] == "2023-04-04"
    assert describe.preview(sales, 14).truncated is False
    moments = small_table(
        spark,
        [(datetime(2024, 1, 2, 3, 4, 5, 60), date(2024, 1, 2)), (datetime(2024, 1, 2, 3, 4, 5), None)],
        "at timestamp_ntz, day date",
    )
    rows = describe.preview_rows(moments).collect()
    assert [row["at"] for row in rows] == ["2024-01-02T03:04:05.000060", "2024-01-02T03:04:05"]
    assert [row["day"] for row in rows] == ["2024-01-02", None]


def test_catalog(spark, tmp_path):
    catalog = DatasetCatalog(spark, str(tmp_path / "catalog"))
    assert catalog.list().count() == 0
    with pytest.raises(KeyError):
        catalog.get("b")
    catalog.register(RegisteredDataset("b", "t_b", "/b", 1))
    catalog.register(RegisteredDataset("a", "t_a", "/a", 2))
    catalog.register(RegisteredDataset("b", "t_b2", "/b2", 3))
    assert [row["dataset_name"] for row in catalog.list().collect()] == ["a", "b"]
    assert catalog.get("b").row_count == 3
    catalog.update("b", profile_path="/profiles/b")
    catalog.update("b", semantic_path="/semantics/b")
    found = catalog.get("b")
    assert (found.profile_path, found.semantic_path, found.table_name) == ("/profiles/b", "/semantics/b", "t_b2")
    with pytest.raises(ValueError, match="Cannot update"):
        catalog.update("b", row_count="9")
    with pytest.raises(KeyError):
        catalog.update("c", profile_path="x")


def test_crossing_updates_of_the_catalog_both_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "catalog")
    catalog, other = DatasetCatalog(spark, path), DatasetCatalog(spark, path)
    catalog.register(RegisteredDataset("a", "t_a", "/a", 1, "/first"))

    def update_in_between(change, inner):
        """``inner`` runs after the update of ``change`` has read the catalog and before it writes."""
        read = DatasetCatalog._row

        def row(self, name):
            found = read(self, name)
            monkeypatch.setattr(DatasetCatalog, "_row", read)
            inner()
            return found

        monkeypatch.setattr(DatasetCatalog, "_row", row)
        catalog.update("a", **change)

    update_in_between({"profile_path": "/p"}, lambda: other.update("a", semantic_path="/s"))
    found = catalog.get("a")
    assert (found.profile_path, found.semantic_path, found.location) == ("/p", "/s", "/first")
    update_in_between({"profile_path": "/of the first"}, lambda: other.register(RegisteredDataset("a", "t_a", "/a", 2, "/second")))
    found = catalog.get("a")
    assert (found.location, found.profile_path, found.semantic_path) == ("/second", None, None)
    update_in_between({"profile_path": "/new"}, lambda: other.compact())
    assert catalog.get("a").profile_path == "/new"


def test_a_compacted_catalog_reads_few_files(spark, tmp_path):
    path = str(tmp_path / "catalog")
    old = spark.createDataFrame([("old", "t", "/o", None, 3, None, "/s", None, 5)], DATASET_SCHEMA)
    old.write.parquet(path)
    catalog = DatasetCatalog(spark, path, most_files=4)
    for n in range(7):
        catalog.register(RegisteredDataset(f"d{n % 3}", f"t{n}", "/x", n))
        catalog.update(f"d{n % 3}", profile_path=f"/p{n}")
        assert len(catalog.table().inputFiles()) <= 4
    rows = {row["dataset_name"]: row for row in catalog.list().collect()}
    assert {name: (row["table_name"], row["profile_path"]) for name, row in rows.items()} == {
        "old": ("t", None), "d0": ("t6", "/p6"), "d1": ("t4", "/p4"), "d2": ("t5", "/p5")
    }
    assert rows["old"]["semantic_path"] == "/s"
    before = sorted(map(str, rows.values()))
    assert catalog.compact() > 1
    assert catalog.compact() == 1
    assert sorted(map(str, catalog.list().collect())) == before
    assert DatasetCatalog(spark, str(tmp_path / "none")).compact() == 0


def test_saved_results(spark, sales, tmp_path):
    root = str(tmp_path / "state")
    for reader in (store.read_profile, store.read_model, store.read_evidence):
        with pytest.raises(FileNotFoundError):
            reader(spark, root, "sales")

    profile = profile_dataset("sales", sales)
    store.write_profile(profile, root)
    saved = store.read_profile(spark, root, "sales")
    columns = sorted(saved.columns)
    wanted = profile.table().select(*columns).collect()
    assert sorted(map(str, saved.select(*columns).collect())) == sorted(map(str, wanted))

    model = build_semantic_model("sales", "sales", column_profile(sales), "retail")
    assert model.business_rules[-1] == "Business context: retail"
    store.write_model(spark, model, root)
    assert store.read_model(spark, root, "sales") == model

    report = run_analysis("sales", sales, model=model)
    kept = store.write_evidence(report, root)
    assert kept.findings.count() == report.findings.count() == 27
    assert kept.summary.first() == report.summary.first()
    assert spark.read.parquet(store.ranked_path(root, "sales")).filter("rank = 1").count() == 1
    store.write_evidence(kept, str(tmp_path / "copy"))

    result = sales.groupBy("region").count()
    store.write_result(result, root + "/result")
    assert store.read_result(spark, root + "/result", result.schema).count() == 3


def test_config(spark, tmp_path):
    payload = {"project": "p", "metrics": [{"name": "m", "expression": "SUM(x)"}], "synonyms": {"a": ["b"]}}
    path = tmp_path / "config.json"
    path.write_text(json.dumps(payload))
    config = store.read_config(spark, str(path))
    assert (config.project, config.metrics[0]["name"], config.synonyms) == ("p", "m", {"a": ["b"]})
    pytest.importorskip("yaml")
    path = tmp_path / "config.yaml"
    path.write_text("project: q\nforbidden_tables:\n  - secret\n")
    assert store.read_config(spark, str(path)).forbidden_tables == ("secret",)


def test_jdbc_options(spark):
    options = jdbc.jdbc_options("jdbc:x", table="t", partition_column="id", bounds=(1, 9), num_partitions=4)
    assert (options["dbtable"], options["lowerBound"], options["numPartitions"]) == ("t", "1", "4")
    assert jdbc.jdbc_options("jdbc:x", query="SELECT 1;")["dbtable"] == "(SELECT 1) source"
    empty = jdbc.jdbc_options("jdbc:x", table="t", partition_column="id", bounds=(None, None), num_partitions=4)
    assert empty == jdbc.jdbc_options("jdbc:x", table="t")
    with pytest.raises(ValueError, match="either"):
        jdbc.jdbc_options("jdbc:x")
    with pytest.raises(ValueError, match="bounds"):
        jdbc.jdbc_options("jdbc:x", table="t", partition_column="id")
    with pytest.raises(ValueError, match="not read-only"):
        jdbc.read_jdbc(spark, "jdbc:x", query="DROP TABLE t")
    with pytest.raises(ValueError, match="single_task"):
        jdbc.read_jdbc(spark, "jdbc:x", table="t")


def test_small_table(spark):
    schema = "a int, b string, c array<string>, d double"
    rows = [(1, None, [], None), (2, None, ["x"], 0.5)]
    assert [tuple(row) for row in small_table(spark, rows, schema).collect()] == rows
    assert small_table(spark, [], schema).count() == 0


def test_shared_folder(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert load(spark, "region").count() == 5


def test_notes_of_many_sessions_share_files(spark, tmp_path):
    turns = spark.range(60_000).select(
        F.expr("IF(id < 20000, 'hot', CONCAT('s', id % 20000))").alias("session"),
        F.col("id").alias("seq"),
        F.concat(F.lit("ask "), "id").alias("user"),
        F.lit("reply").alias("assistant"),
        F.lit("chat").alias("mode"),
    )
    notes = conversation.conversation_notes(turns)
    path = str(tmp_path / "notes")
    store.write_note_table(notes, path, file_rows=5_000)
    saved = spark.read.parquet(f"{path}/notes")
    assert saved.count() == 60_000
    assert len(saved.inputFiles()) <= 60_000 // 5_000 + 8 + 1
    found = store.read_note_table(spark, path, "s77.md")
    assert len(found.inputFiles()) == 1
    assert [(row["turn_no"], "ask 20077" in row["note"]) for row in found.collect()] == [(1, True), (2, False)]
    hot = store.read_note_table(spark, path, "hot.md").collect()
    assert [row["turn_no"] for row in hot] == list(range(1, 20_001))
    assert store.read_note_table(spark, path, "absent.md").count() == 0
    store.write_note_table(notes.limit(0), path)
    assert store.read_note_table(spark, path, "s77.md").count() == 0
