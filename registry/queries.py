"""Registered queries: name to ``(spark, sf_dir) -> DataFrame``, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.tables import (
    as_messages,
    lineitem_with_gaps,
    load,
    metric_log,
    order_findings,
    query_log,
    user_messages,
)
from tallyline.models import Metric, SemanticModel
from tallyline.operators import conversation, diagnostics, interpret, overview, segments, semantic, series, sql_audit
from tallyline.operators import findings as ranking
from tallyline.operators import profile as profiles
from tallyline.plans.guarded import guarded_query
from tallyline.plans.report import AnalysisReport, run_analysis
from tallyline.session import scratch_path
from tallyline.sources import catalog, describe, ingest, store

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

PROFILED = ("customer", "events", "lineitem", "orders", "part", "supplier")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name).cast("double"), digits).alias(name)


def s(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def joined(name: str, separator: str = ",") -> Column:
    return F.array_join(name, separator).alias(name)


# Sources and catalog


@query
def ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV by Spark, then loaded with inferred types."""
    files = scratch_path(spark, "orders-csv")
    load(spark, sf_dir, "orders").write.csv(files, header=True)
    result = ingest.ingest_csv(
        spark, files, "Orders from CSV", replace=True, location=scratch_path(spark, "orders-table")
    )
    return _ingested(spark, result)


@query
def ingest_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ingest.ingest_parquet(
        spark,
        f"{sf_dir}/orders.parquet",
        "Orders from Parquet",
        replace=True,
        dataset="order data",
        location=scratch_path(spark, "orders-table"),
    )
    return _ingested(spark, result)


def _ingested(spark: SparkSession, result: ingest.IngestResult) -> DataFrame:
    return (
        spark.table(result.dataset_name)
        .groupBy("o_orderpriority")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("o_custkey").cast("bigint").alias("customers"),
            F.round(F.sum("o_totalprice"), 2).alias("price"),
            F.min("o_orderdate").cast("string").alias("first_date"),
        )
        .withColumn("row_count", F.lit(result.row_count).cast("bigint"))
        .withColumn("table_name", F.lit(result.table_name))
    )


@query
def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = ("customer", "part", "nation", "orders")
    return _per_table(
        tables,
        lambda name: describe.describe_table(load(spark, sf_dir, name)).select(
            "ordinal", "column", joined("samples", "|")
        ),
    )


@query
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = describe.preview(load(spark, sf_dir, "orders"), limit=20, order_by=["o_orderkey"])
    return seen.rows.withColumn("row_count", F.lit(seen.row_count).cast("bigint")).withColumn(
        "truncated", F.lit(int(seen.truncated))
    )


@query
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as catalog entries, orders as later changes to them."""
    entries = load(spark, sf_dir, "events").select(
        F.concat(F.lit("set "), F.col("user_id")).alias("dataset_name"),
        F.col("event_type").alias("table_name"),
        F.col("props").alias("source_path"),
        F.col("event_id").alias("seq"),
    )
    changes = load(spark, sf_dir, "orders").select(
        F.concat(F.lit("set "), F.col("o_custkey")).alias("dataset_name"),
        F.col("o_orderpriority").alias("table_name"),
        F.col("o_orderstatus").alias("source_path"),
        (F.col("o_orderkey") + 10_000_000_000).alias("seq"),
    )
    return catalog.upsert(entries, changes, ["dataset_name"], "seq")


# Profile


def _per_table(names: tuple[str, ...], make: Callable[[str], DataFrame]) -> DataFrame:
    result = None
    for name in names:
        part = make(name).withColumn("table_name", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return result


@query
def profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = profiles.column_profile(lineitem_with_gaps(spark, sf_dir))
    return profile.select("ordinal", "column", "row_count", "null_count", "null_rate")


@query
def profile_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_table(
        PROFILED,
        lambda name: profiles.column_profile(load(spark, sf_dir, name)).select("column", "distinct_count"),
    )


@query
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_table(("part", "orders"), lambda name: profiles.top_values(load(spark, sf_dir, name)))


@query
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = profiles.numeric_profile(load(spark, sf_dir, "lineitem"))
    return profile.select("column", r("min"), r("max"), r("mean"), r("median"), r("stddev"))


@query
def profile_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_table(
        PROFILED, lambda name: profiles.role_profile(load(spark, sf_dir, name)).select("ordinal", "column", "role")
    )


def _dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").withColumn("due_date", F.expr("o_orderdate + interval 30 days"))


@query
def profile_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of each time column, and that of the data set, which is the last one's."""
    columns = ["o_orderdate", "due_date"]
    frame = _dated_orders(spark, sf_dir)
    ranges = profiles.date_ranges(frame, columns).drop("ordinal")
    whole = profiles.dataset_date_range(frame, columns).withColumn("column", F.lit("*"))
    return ranges.unionByName(whole).select("column", s("date_min"), s("date_max"))


@query
def profile_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_table(
        PROFILED,
        lambda name: profiles.candidates(profiles.role_profile(load(spark, sf_dir, name))).select(
            joined("time_columns"), joined("dimension_columns"), joined("measure_columns")
        ),
    )


@query
def profile_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = profiles.profile_dataset("orders", load(spark, sf_dir, "orders")).table()
    tops = F.transform("top_values", lambda top: F.concat(top["value"], F.lit(":"), top["count"]))
    return table.select(
        "ordinal",
        "column",
        "role",
        "row_count",
        "null_rate",
        "distinct_count",
        r("min"),
        r("max"),
        r("mean"),
        r("median"),
        r("stddev"),
        F.array_join(tops, "|").alias("top_values"),
        s("date_min"),
        s("date_max"),
    )


# Semantic layer


def _lineitem_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.role_profile(load(spark, sf_dir, "lineitem"))


@query
def semantic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_table(
        PROFILED,
        lambda name: semantic.metrics_from_profile(profiles.role_profile(load(spark, sf_dir, name))).select(
            "place", "name", "sql", "description", "confidence"
        ),
    )


@query
def semantic_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_table(
        PROFILED,
        lambda name: semantic.dimensions_from_profile(profiles.role_profile(load(spark, sf_dir, name))).select(
            "name", "column", "grain", "description", "confidence"
        ),
    )


@query
def semantic_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All problems of metric definitions, dimensions and rules made from the events."""
    events = load(spark, sf_dir, "events")
    dimensions = events.select(
        F.concat(F.lit("d"), F.col("event_id")).alias("name"),
        F.when(F.col("event_type") == "error", F.lit("missing")).otherwise(F.col("event_type")).alias("column"),
    )
    columns = ["value", "view", "click", "purchase", "signup"]
    rules = events.select(
        F.concat(
            F.lit("Prefer total_"),
            F.col("event_id") * 2,
            F.lit(" over dim_d"),
            F.col("event_id") * 3,
            F.lit(" and total"),
        ).alias("rule")
    )
    return semantic.semantic_problems(metric_log(spark, sf_dir), dimensions, columns, rules, "ts")


def _metric(sql: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        values = semantic.evaluate_metrics(load(spark, sf_dir, "lineitem"), (Metric("metric_value", sql),))
        return values.select(F.round(F.col("metric_value").cast("double"), 6).alias("metric_value"))

    return run


QUERIES |= {
    "metric_sum": _metric("SUM(l_quantity)"),
    "metric_avg": _metric("AVG(l_quantity)"),
    "metric_min": _metric("min( l_extendedprice )"),
    "metric_max": _metric("MAX(l_extendedprice)"),
    "metric_count": _metric("COUNT(*)"),
}


@query
def explain_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = _lineitem_profile(spark, sf_dir)
    explained = semantic.explain_metrics(
        semantic.metrics_from_profile(profile), semantic.dimensions_from_profile(profile), "l_shipdate"
    )
    return explained.select("metric_name", "description", "sql", joined("dimensions_commonly_used"))


# Overview

QUANTITY, DAY, FLAG, SUPPLIER = "SUM(l_quantity)", "l_shipdate", "l_returnflag", "l_suppkey"


@query
def overview_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = SemanticModel(
        "lineitem",
        "lineitem",
        metrics=(
            Metric("total_l_quantity", QUANTITY),
            Metric("mean_l_discount", "AVG(l_discount)"),
            Metric("rows", "COUNT(*)"),
            Metric("top_l_tax", "MAX(l_tax)"),
        ),
    )
    shown = overview.overview_headline(load(spark, sf_dir, "lineitem"), model)
    return shown.select("metric", r("value"), r("impact"))


@query
def overview_date_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.date_coverage(load(spark, sf_dir, "lineitem"), DAY).select(s("min_date"), s("max_date"))


@query
def overview_top_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = segments.segment_ranking(load(spark, sf_dir, "lineitem"), QUANTITY, SUPPLIER, max_segments=10)
    return top.select("place", "segment", r("value"))


@query
def overview_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = segments.top_concentration(load(spark, sf_dir, "lineitem"), QUANTITY, SUPPLIER)
    return summary.select(r("top_value"), r("total"), r("top_share"), "severity")


# Series, trends, anomalies


def _lineitem_series(spark: SparkSession, sf_dir: str, grain: str, by: tuple[str, ...] = ()) -> DataFrame:
    return series.period_values(load(spark, sf_dir, "lineitem"), QUANTITY, DAY, grain, by)


def _series(grain: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _lineitem_series(spark, sf_dir, grain).select(s("period"), r("value"))

    return run


QUERIES |= {f"series_{grain}": _series(grain) for grain in ("day", "week", "month", "quarter", "year")}


@query
def trend_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = series.trend_deltas(_lineitem_series(spark, sf_dir, "week"))
    return deltas.select(s("period"), r("delta"), r("relative_delta"))


def _week_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.trend_summary(_lineitem_series(spark, sf_dir, "week"))


@query
def trend_max_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _week_summary(spark, sf_dir).select(s("max_increase_period"), r("max_increase"), r("increase_impact"))


@query
def trend_max_decrease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _week_summary(spark, sf_dir).select(s("max_decrease_period"), r("max_decrease"), r("decrease_impact"))


@query
def trend_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _week_summary(spark, sf_dir).select("periods", r("mean"), r("deviation"), r("volatility_ratio"))


@query
def trend_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spikes = series.trend_spikes(_lineitem_series(spark, sf_dir, "week"))
    return spikes.select(s("period"), r("value"), r("z_score"))


@query
def trend_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend summary of every supplier's months, distributed over suppliers."""
    summary = series.trend_summary(_lineitem_series(spark, sf_dir, "month", (SUPPLIER,)), (SUPPLIER,))
    return summary.select(
        SUPPLIER,
        "periods",
        r("last_value"),
        r("max_increase"),
        s("max_increase_period"),
        r("max_decrease"),
        s("max_decrease_period"),
        r("volatility_ratio"),
        "spikes",
    )


@query
def anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = series.period_values(load(spark, sf_dir, "events"), "SUM(value)", "ts", "day", ("event_type",))
    scores = series.anomaly_scores(days, ("event_type",))
    return scores.select(
        "event_type",
        s("period"),
        r("value", 4),
        r("z_score"),
        r("mad_score"),
        r("absolute_delta", 4),
        r("relative_delta"),
        "periods",
    )


@query
def anomaly_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = series.anomaly_flags(_lineitem_series(spark, sf_dir, "week"))
    return flags.select(
        s("period"), r("value"), r("z_score"), r("mad_score"), r("absolute_delta"), r("relative_delta")
    )


@query
def anomaly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = series.anomaly_summary(_lineitem_series(spark, sf_dir, "month", (SUPPLIER,)), (SUPPLIER,))
    return summary.select(SUPPLIER, "periods", "anomalies", "pattern", "severity", r("share"))


# Segments


@query
def segment_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = segments.segment_ranking(load(spark, sf_dir, "lineitem"), QUANTITY, SUPPLIER)
    return ranked.select("place", "segment", r("value"))


def _supplier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_summary(load(spark, sf_dir, "lineitem"), QUANTITY, SUPPLIER)


@query
def segment_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier_summary(spark, sf_dir).select("winner", r("winner_value"), r("total"), r("leader_impact"))


@query
def segment_long_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier_summary(spark, sf_dir).select(r("total"), r("top_total"), r("long_tail_share"))


@query
def segment_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier_summary(spark, sf_dir).select("segments", r("concentration"))


@query
def segment_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier_summary(spark, sf_dir).select("winner", "loser", r("spread"), r("spread_impact"))


@query
def segment_all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary over every part, without the limit on segments."""
    summary = segments.segment_summary(load(spark, sf_dir, "lineitem"), QUANTITY, "l_partkey")
    return summary.select(
        "segments", r("total"), r("long_tail_share"), r("concentration", 9), "winner", "loser", r("spread")
    )


@query
def segment_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier summaries of every return flag."""
    summary = segments.segment_summary(load(spark, sf_dir, "lineitem"), QUANTITY, SUPPLIER, (FLAG,))
    return summary.select(
        FLAG, "segments", r("total"), "winner", "loser", r("long_tail_share"), r("concentration"), r("spread")
    )


# Diagnostics


@query
def diag_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = diagnostics.missingness(lineitem_with_gaps(spark, sf_dir))
    return missing.select("ordinal", "column", "null_count", r("null_rate", 9))


@query
def diag_worst_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = diagnostics.worst_missing(diagnostics.missingness(lineitem_with_gaps(spark, sf_dir)))
    return worst.select("ordinal", "column", r("null_rate", 9))


@query
def diag_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = diagnostics.cardinality(
        load(spark, sf_dir, "events"), ["event_id", "user_id", "event_type", "props", "ts"]
    )
    return ratios.select(
        "dimension", "distinct_count", r("cardinality_ratio", 9), F.col("near_unique").cast("int").alias("near_unique")
    )


@query
def diag_instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = diagnostics.instability(
        load(spark, sf_dir, "lineitem"), DAY, ["l_returnflag", "l_linestatus", "l_suppkey", "l_partkey", "l_shipdate"]
    )
    return ratios.select(
        "dimension", "max_count", "min_count", r("explosion_ratio"), F.col("unstable").cast("int").alias("unstable")
    )


@query
def diag_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which those of one source are there twice."""
    documents = load(spark, sf_dir, "documents").select("lang", "doc_id", "source")
    return diagnostics.duplicate_keys(documents.unionAll(documents.filter("lang = 'en'")))


# Findings and report


@query
def score_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ranking.score_findings(order_findings(spark, sf_dir))
    return scored.select(
        "dataset_name",
        "title",
        r("impact_score"),
        r("confidence_score"),
        r("business_relevance_score"),
        r("combined_score"),
        "severity",
    )


@query
def rank_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(
        F.concat(F.lit("customer "), F.col("o_custkey")).alias("dataset_name")
    )
    ranked = ranking.rank_findings(order_findings(spark, sf_dir), count_in=orders)
    return ranked.select("dataset_name", "title", r("combined_score"), F.col("rank").cast("bigint").alias("rank"))


@query
def executive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = ranking.executive_summary(order_findings(spark, sf_dir))
    return summary.select(
        "dataset_name",
        "headline",
        joined("top_findings", "|"),
        joined("key_risks", "|"),
        joined("caveats", "|"),
        joined("follow_up_questions", "|"),
    )


def _ranked(report: AnalysisReport) -> DataFrame:
    return report.ranked.select(
        F.col("rank").cast("bigint").alias("rank"),
        "title",
        "metric",
        F.array_join("dimensions", ",").alias("dimensions"),
        F.col("evidence")[0]["query_id"].alias("query_id"),
        r("impact_score"),
        r("combined_score"),
        "severity",
    )


def _report(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _ranked(run_analysis("lineitem", load(spark, sf_dir, "lineitem"), mode=mode))

    return run


@query
def saved_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The executive report over its evidence, written and read back."""
    report = run_analysis("lineitem", load(spark, sf_dir, "lineitem"))
    return _ranked(store.write_evidence(report, scratch_path(spark, "state")))


QUERIES |= {
    "run_analysis": _report("executive_summary"),
    "run_analysis_overview": _report("overview"),
    "run_analysis_diagnostic": _report("diagnostic"),
    "run_analysis_deep_dive": _report("deep_dive"),
}


# Guarded SQL


@query
def sql_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_audit.normalize_log(query_log(spark, sf_dir)).select("id", "normalized_sql")


@query
def sql_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    limited = sql_audit.limit_log(query_log(spark, sf_dir), 50, 1000)
    return limited.select("id", "limited_sql", F.col("rewritten").cast("int").alias("rewritten"), "warning")


@query
def sql_table_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_audit.audit_log(query_log(spark, sf_dir)).select("id", joined("table_refs"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    audited = sql_audit.audit_log(
        query_log(spark, sf_dir), forbidden_tables=["secret_table"], allowed_tables=["orders", "customer"]
    )
    return audited.select("id", "checked_sql", joined("errors", "; "), F.col("passed").cast("int").alias("passed"))


QUERIES["sql_audit"] = _audited


TOP_PRICES = (
    "```sql\nSELECT o_custkey, COUNT(*) AS order_count, ROUND(SUM(o_totalprice), 2) AS total_price "
    "FROM checked_orders GROUP BY o_custkey ORDER BY total_price DESC, o_custkey\n```"
)


def _guarded(spark: SparkSession, sf_dir: str, text: str, row_limit: int) -> DataFrame:
    load(spark, sf_dir, "orders").createOrReplaceTempView("checked_orders")
    return guarded_query(spark, text, row_limit, 1000, allowed_tables=["checked_orders"]).data


@query
def guarded_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guarded(spark, sf_dir, TOP_PRICES, 25)


# Results


@query
def result_top_insight(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = segments.segment_ranking(load(spark, sf_dir, "lineitem"), QUANTITY, SUPPLIER).select(
        "segment", F.col("value").cast("bigint").alias("total_quantity")
    )
    return interpret.top_insight(result, "Which supplier ships most?", preview_rows=None)


@query
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _lineitem_series(spark, sf_dir, "quarter").select(
        F.col("value").alias("quantity"), F.col("period").cast("date").alias("ship_date")
    )
    return interpret.chart_series(result).select("hint", "label", r("value"))


# Conversations


@query
def conv_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.conversation_modes(user_messages(spark, sf_dir)).select("session", "seq", "mode")


@query
def conv_modes_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user messages of the conversation log."""
    users = load(spark, sf_dir, "conversations").filter("role = 'user'")
    return conversation.conversation_modes(users, ("conv_id",), "turn").select("conv_id", "turn", "mode")


@query
def conv_previous_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversation.previous_queries(user_messages(spark, sf_dir), sql="sql")
    return found.select("session", "seq", "mode", "previous_query", "previous_sql", "reply")


@query
def conv_follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.resolve_follow_ups(user_messages(spark, sf_dir), sql="sql").select(
        "session", "seq", "resolved"
    )


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.pair_turns(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query
def conv_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "conversations")
    found = conversation.recent_history(_turns(spark, sf_dir), ("conv_id",), "turn", count_in=log)
    return found.select("conv_id", "turn", "history")


@query
def conv_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "conversations")
    classified = conversation.conversation_modes(_turns(spark, sf_dir), ("conv_id",), "turn", "user", count_in=log)
    return conversation.conversation_notes(classified, "conv_id", "turn", count_in=log)


@query
def conv_notes_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of the event messages, with replies and SQL, under sessions whose names need cleaning."""
    found = conversation.previous_queries(user_messages(spark, sf_dir))
    turns = found.select(
        F.concat(F.lit(".team/"), F.col("session"), F.lit(" review.")).alias("session"),
        "seq",
        F.col("text").alias("user"),
        F.col("reply").alias("assistant"),
        "mode",
        F.when(F.col("mode") == "query", F.col("sql")).alias("sql"),
    )
    users = load(spark, sf_dir, "events").select(F.col("user_id").alias("session"))
    return conversation.conversation_notes(turns, sql="sql", count_in=users)


@query
def conv_query_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replies to queries whose results have the columns that the kind of event has."""
    kind = F.col("event_type")
    columns = (
        F.when(kind == "view", F.array(F.lit("region"), F.lit("units")))
        .when(kind == "click", F.array(F.lit("category")))
        .otherwise(F.array().cast("array<string>"))
    )
    results = load(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("Found "), "event_id", F.lit(".")).alias("summary"),
        (F.col("event_id") % 3).alias("row_count"),
        columns.alias("columns"),
        F.concat(F.lit("{"), kind, F.lit("}")).alias("first_row"),
    )
    replies = conversation.query_replies(results, ["revenue", "units"], ["category", "region"])
    return replies.select("event_id", "reply")
