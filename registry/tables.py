"""The given tables, and tables derived from the whole of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with nulls in four columns, at different rates."""
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.nullif(F.col("l_linenumber"), F.lit(1)).alias("l_linenumber"),
        F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("l_quantity"),
        F.nullif(F.col("l_returnflag"), F.lit("A")).alias("l_returnflag"),
        F.nullif(F.col("l_linestatus"), F.lit("F")).alias("l_linestatus"),
        "l_shipdate",
    )


def user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a user message; the session is the user."""
    return as_messages(load(spark, sf_dir, "events"))


def as_messages(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", "show top customers by revenue")
        .when(kind == "click", "filter that to one row")
        .when(kind == "purchase", "what sql did you use previously?")
        .when(kind == "signup", "hello there")
        .otherwise("summarize the takeaway")
    )
    return events.select(
        F.col("user_id").alias("session"),
        F.col("event_id").alias("seq"),
        F.concat(text, F.lit(" #"), F.col("event_id")).alias("text"),
        F.concat(F.lit("SELECT "), F.col("event_id")).alias("sql"),
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a query text: reads, writes, several statements, comments, fences, limits."""
    n = F.col("event_id")
    text = F.concat
    case = F.pmod(n, F.lit(10))
    sql = (
        F.when(case == 0, text(F.lit("SELECT * FROM orders LIMIT "), n))
        .when(case == 1, text(F.lit("DROP TABLE t"), n))
        .when(case == 2, text(F.lit("SELECT "), n, F.lit("; SELECT 2")))
        .when(case == 3, text(F.lit("  ```sql\nSELECT a FROM main.orders o JOIN Customer c ON 1 = 1 -- "), n, F.lit("\n```")))
        .when(case == 4, text(F.lit("sql with x as (select "), n, F.lit(") select * from x;")))
        .when(case == 5, text(F.lit("SELECT 1 /* delete\n"), n, F.lit(" */ FROM secret_table limit 5000")))
        .when(case == 6, text(F.lit("select replace(a, 'b', '"), n, F.lit("') from information_schema.tables")))
        .when(case == 7, F.lit("-- nothing"))
        .when(case == 8, text(F.lit("UPDATE orders SET a = "), n, F.lit(";")))
        .otherwise(text(F.lit("SELECT o_orderkey FROM orders WHERE o_orderkey = "), n, F.lit(";;")))
    )
    return load(spark, sf_dir, "events").select(n.alias("id"), sql.alias("sql"))


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a metric definition, some of them wrong."""
    n = F.col("event_id")
    case = F.pmod(n, F.lit(7))
    sql = (
        F.when(case == 0, "SUM(value)")
        .when(case == 1, "avg( value )")
        .when(case == 2, "COUNT(*)")
        .when(case == 3, "SUM(nothing)")
        .when(case == 4, "MEDIAN(value)")
        .when(case == 5, "SUM(value) + 1")
        .otherwise("max(*)")
    )
    return load(spark, sf_dir, "events").select(F.concat(F.lit("total_"), n).alias("name"), sql.alias("sql"))


def order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unscored findings over all orders: one per customer and priority."""
    counted = (
        load(spark, sf_dir, "orders")
        .groupBy("o_custkey", "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    )
    n, finished = F.col("n"), F.col("finished")
    subject = F.when(F.col("o_orderpriority") == "1-URGENT", "Delivery risk ").otherwise("Orders ")
    observation = (
        F.when(n >= 5, F.concat(F.lit("Found "), n, F.lit(" orders, sales of -"), finished, F.lit(".5 per year")))
        .when(finished > 0, F.lit("Finished orders only"))
        .otherwise(F.concat(n, F.lit(" open, at risk: "), n * 20))
    )
    return counted.select(
        F.concat(F.lit("customer "), F.col("o_custkey")).alias("dataset_name"),
        F.ascii("o_orderpriority").cast("int").alias("task_no"),
        F.lit(0).alias("finding_no"),
        F.concat(subject, F.col("o_orderpriority")).alias("title"),
        observation.alias("observation"),
        F.when(finished > 1, F.lit("total_orders")).alias("metric"),
        F.when(n % 3 == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), n / 8.0)).alias("impact_score"),
        F.when(finished == 1, F.lit(0.0)).otherwise(finished / 5.0).alias("confidence_score"),
        F.when(n % 2 == 0, F.lit(0.0)).otherwise(F.lit(0.6)).alias("business_relevance_score"),
        F.lit("low").alias("severity"),
        F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), finished.cast("int") % 4).alias("caveats"),
        F.when(n > 3, F.array(F.lit("orders"))).otherwise(F.array().cast("array<string>")).alias("evidence"),
    )
