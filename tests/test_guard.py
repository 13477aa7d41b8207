"""Guarded SQL and the audit of query texts."""

from __future__ import annotations

import pytest
from conftest import SF_DIR, load
from pyspark.sql import functions as F

from tallyline.functions import sqltext
from tallyline.operators.sql_audit import audit_log, check_text, limit_log, normalize_log
from tallyline.plans.guarded import UnsafeQuery, guarded_query, refused_relations, relations


@pytest.mark.parametrize(
    ("text", "forbidden", "allowed", "errors"),
    [
        ("DELETE FROM x", [], [], ["Only SELECT/CTE queries are allowed", "Forbidden keyword detected: delete"]),
        ("SELECT 1", [], [], []),
        ("SELECT 1;", [], [], []),
        ("SELECT 1; SELECT 2", [], [], ["Multiple statements are not allowed"]),
        ("SELECT * FROM secret_table", ["Secret_Table"], [], ["Forbidden table referenced: secret_table"]),
        (
            "SELECT * FROM other_table",
            [],
            ["public_view"],
            ["Disallowed table(s) referenced: other_table. Use only allowed_tables."],
        ),
        ("-- drop\nSELECT 1 /* delete\n */", [], [], []),
        ("  -- nothing", [], [], ["SQL is empty"]),
        ("select dropped, created_at from updates", [], [], []),
        ("select * from pg_catalog.x", [], [], ["System table/schema access blocked: pg_catalog"]),
        ("WITH a AS (SELECT 1) SELECT * FROM a", [], ["t"], [
            "Disallowed table(s) referenced: a. Use only allowed_tables."
        ]),
    ],
)
def test_rules(spark, text, forbidden, allowed, errors):
    assert check_text(spark, text, forbidden, allowed) == errors


def test_normalize(spark):
    texts = {
        "```sql\nSELECT 1\n```": "SELECT 1",
        "``` SELECT 1```": "SELECT 1",
        "SQL select 2 ": "select 2",
        " sqlite ": "sqlite",
    }
    log = spark.createDataFrame([(text,) for text in texts], "sql string")
    assert {row["sql"]: row["normalized_sql"] for row in normalize_log(log).collect()} == texts


def test_limits(spark):
    texts = [
        ("SELECT * FROM items", "SELECT * FROM items LIMIT 50", True, None),
        ("SELECT * FROM items;", "SELECT * FROM items LIMIT 50", True, None),
        ("SELECT * FROM items LIMIT 5000", "SELECT * FROM items LIMIT 100", True,
         "LIMIT 5000 capped to max_row_limit=100"),
        ("SELECT * FROM items limit 7", "SELECT * FROM items limit 7", False, None),
        ("SELECT * FROM (SELECT 1 LIMIT 900) x LIMIT 800", "SELECT * FROM (SELECT 1 LIMIT 100) x LIMIT 800", True,
         "LIMIT 900 capped to max_row_limit=100"),
    ]
    log = spark.createDataFrame([(row[0],) for row in texts], "sql string")
    rows = {row["sql"]: tuple(row)[1:] for row in limit_log(log, 50, 100).collect()}
    assert rows == {row[0]: row[1:] for row in texts}
    huge = log.limit(1).select(F.lit("SELECT 1 LIMIT " + "9" * 60).alias("sql"))
    assert limit_log(huge, 50, 100).first()["limited_sql"] == "SELECT 1 LIMIT 100"
    assert sqltext.safe_limit(0, 100) == 1
    assert sqltext.safe_limit(500, 100) == 100


def test_audit_log(spark):
    log = spark.createDataFrame([(1, "SELECT a FROM x.y JOIN Z ON 1 = 1"), (2, "DROP TABLE y")], "id int, sql string")
    rows = audit_log(log).orderBy("id").collect()
    assert rows[0]["table_refs"] == ["y", "z"]
    assert [row["passed"] for row in rows] == [True, False]


@pytest.fixture(scope="module")
def views(spark):
    load(spark, "orders").createOrReplaceTempView("guard_orders")
    load(spark, "customer").createOrReplaceTempView("guard_customer")


def run(spark, text, row_limit=3, cap=5):
    return guarded_query(spark, text, row_limit, cap, allowed_tables=["guard_orders"])


def test_guarded_run(spark, views):
    result = run(spark, "```sql\nSELECT o_orderkey FROM guard_orders ORDER BY 1;\n```").run()
    assert result.sql == "SELECT o_orderkey FROM guard_orders ORDER BY 1"
    assert ([row[0] for row in result.rows], result.row_count, result.truncated) == ([0, 1, 2], 3, True)
    capped = run(spark, "SELECT o_orderkey FROM guard_orders ORDER BY 1 LIMIT 100").run()
    assert (capped.row_count, capped.truncated) == (5, True)
    assert capped.warnings == ["LIMIT 100 capped to max_row_limit=5"]
    kept = run(spark, "SELECT o_orderkey FROM guard_orders ORDER BY 1 LIMIT 4").run()
    assert (kept.row_count, kept.truncated) == (4, False)
    inner = run(spark, "SELECT o.o_orderkey FROM guard_orders o WHERE 1 IN (SELECT 1 FROM guard_orders LIMIT 2)")
    assert inner.run().row_count == 5


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE guard_orders",
        "SELECT * FROM guard_customer",
        "SELECT * FROM `guard_customer`",
        "SELECT * FROM guard_orders, guard_customer",
        "SELECT * FROM parquet.`/tmp/x`",
        "SELECT * FROM guard_orders; SELECT 1",
        "",
    ],
)
def test_refused(spark, views, text):
    with pytest.raises(UnsafeQuery):
        run(spark, text)


def test_the_text_runs_as_it_stands(spark):
    spark.range(3000).createOrReplaceTempView("guard_numbers")
    ask = lambda text, *own: guarded_query(spark, text, 100, 1000, ["guard_numbers", *own])
    counted = ask("SELECT count(*) FROM (SELECT id FROM guard_numbers LIMIT 5000)").run()
    assert (counted.rows[0][0], counted.truncated) == (3000, False)
    assert ask("SELECT 'limit 5000' AS t FROM guard_numbers WHERE id = 1").run().rows[0].t == "limit 5000"
    cut = ask("SELECT id FROM guard_numbers LIMIT 5000")
    assert cut.data.count() == 1000 and cut.truncated() and cut.run().truncated
    named = "WITH picked AS (SELECT id FROM guard_numbers) SELECT max(id) FROM picked"
    assert ask(named, "picked").run().rows[0][0] == 2999
    with pytest.raises(UnsafeQuery, match="picked"):
        ask(named)


@pytest.mark.parametrize(
    ("text", "allowed", "forbidden"),
    [
        ("SELECT * FROM guard_orders, guard_customer", [], ["guard_customer"]),
        ("SELECT * FROM `guard_customer`", [], ["guard_customer"]),
        ("SELECT * FROM guard_orders, other.hidden", ["guard_orders"], []),
        ("SELECT * FROM other.guard_orders", ["guard_orders"], []),
        ("SELECT * FROM guard_orders WHERE o_custkey IN (SELECT c_custkey FROM `guard_customer`)", ["guard_orders"], []),
        ("SELECT 'CTE [guard_customer]' FROM guard_orders, guard_customer", ["guard_orders"], []),
        ("WITH x AS (SELECT * FROM guard_orders) SELECT * FROM x, `guard_customer`", ["guard_orders"], []),
        ("SELECT * FROM spark_catalog.other.t", [], ["other.t"]),
    ],
)
def test_tables_are_taken_from_the_plan(spark, views, text, allowed, forbidden):
    with pytest.raises(UnsafeQuery):
        guarded_query(spark, text, 3, 5, allowed, forbidden)


@pytest.fixture(scope="module")
def secrets(spark):
    spark.range(3).createOrReplaceTempView("secret_table")
    spark.range(5).createOrReplaceTempView("ok")
    spark.range(3).createOrReplaceGlobalTempView("guard_global")
    spark.sql("CREATE OR REPLACE TEMP VIEW over_secret AS SELECT * FROM secret_table")
    spark.sql("CREATE OR REPLACE TEMP VIEW over_over AS SELECT * FROM over_secret")
    spark.sql("CREATE TABLE IF NOT EXISTS guard_kept USING parquet AS SELECT id FROM range(4)")
    yield
    spark.sql("DROP TABLE guard_kept")


HIDING = [
    "WITH secret_table AS (SELECT * FROM secret_table) SELECT * FROM secret_table",
    "SELECT * FROM secret_table UNION ALL (WITH secret_table AS (SELECT 1L AS id) SELECT * FROM secret_table)",
    "SELECT * FROM IDENTIFIER('secret' || '_table')",
    "WITH a AS (WITH b AS (SELECT * FROM (`secret_table`)) SELECT * FROM b) SELECT * FROM a",
    "WITH ok AS (SELECT * FROM IDENTIFIER('secret_table')) SELECT * FROM ok",
    "SELECT (SELECT max(id) FROM (SELECT * FROM `secret_table`)) AS m",
    "SELECT id FROM ok WHERE EXISTS (SELECT 1 FROM `secret_table` s WHERE s.id = ok.id)",
]


@pytest.mark.parametrize("text", HIDING)
def test_hidden_tables_are_refused_by_the_plan(spark, secrets, text):
    """The plan alone sees them, without the rules for texts."""
    found = relations(spark.sql(text))
    assert any(one.name == ("secret_table",) for one in found)
    assert "secret_table" in refused_relations(spark, found, ["secret_table"], [])
    assert "secret_table" in refused_relations(spark, found, [], ["ok"])
    for forbidden, allowed in ((["secret_table"], []), ([], ["ok", "a", "b"])):
        with pytest.raises(UnsafeQuery):
            guarded_query(spark, text, 3, 5, allowed, forbidden)


def test_names_of_the_query_are_no_tables(spark, secrets):
    shadow = "WITH secret_table AS (SELECT id FROM ok) SELECT count(*) FROM secret_table"
    assert refused_relations(spark, relations(spark.sql(shadow)), ["secret_table"], ["ok"]) == []
    nested = "WITH a AS (WITH b AS (SELECT id FROM ok) SELECT id FROM b) SELECT count(*) AS n FROM a"
    assert guarded_query(spark, nested, 3, 5, ["ok", "a", "b"]).run().rows[0].n == 5


@pytest.mark.parametrize(
    ("text", "forbidden", "allowed", "refused"),
    [
        ("SELECT * FROM over_over", ["secret_table"], [], ["secret_table"]),
        ("SELECT * FROM over_over", ["secret_table"], ["over_over"], []),
        ("SELECT * FROM over_over", ["secret_table"], ["over_secret"], ["over_over"]),
        ("SELECT * FROM over_over", [], ["secret_table"], ["over_over"]),
        ("SELECT * FROM over_secret", ["over_secret"], ["over_secret"], ["over_secret"]),
        ("SELECT * FROM guard_kept", [], ["guard_kept"], []),
        ("SELECT * FROM default.guard_kept", [], ["spark_catalog.default.guard_kept"], []),
        ("SELECT * FROM guard_kept, ok", ["default.guard_kept"], [], ["spark_catalog.default.guard_kept"]),
        ("SELECT * FROM global_temp.guard_global", [], ["ok"], ["global_temp.guard_global"]),
        ("SELECT * FROM global_temp.guard_global", ["guard_global"], [], ["global_temp.guard_global"]),
        ("SELECT * FROM range(3)", [], ["ok"], []),
        ("SELECT * FROM VALUES (1), (2)", [], ["ok"], []),
    ],
)
def test_relations_of_the_plan(spark, secrets, text, forbidden, allowed, refused):
    assert refused_relations(spark, relations(spark.sql(text)), forbidden, allowed) == refused


def test_paths_have_no_names(spark):
    found = relations(spark.sql(f"SELECT * FROM parquet.`{SF_DIR}/nation.parquet`"))
    assert [one.name for one in found] == [()]
    assert refused_relations(spark, found, [], []) == ["a path"]
