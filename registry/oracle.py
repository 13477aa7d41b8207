"""The SQL that must give the same rows as the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# The columns of the profiled tables: name and kind (n numeric, s text, t time).
COLUMNS = {
    "customer": "c_custkey n,c_name s,c_nationkey n,c_acctbal n,c_mktsegment s",
    "events": "event_id n,ts t,user_id n,event_type s,value n,props s",
    "lineitem": "l_orderkey n,l_partkey n,l_suppkey n,l_linenumber n,l_quantity n,l_extendedprice n,l_discount n,"
    "l_tax n,l_returnflag s,l_linestatus s,l_shipdate t",
    "orders": "o_orderkey n,o_custkey n,o_orderstatus s,o_totalprice n,o_orderdate t,o_orderpriority s",
    "part": "p_partkey n,p_name s,p_brand s,p_type s,p_size n,p_retailprice n",
    "supplier": "s_suppkey n,s_name s,s_nationkey n,s_acctbal n",
    "nation": "n_nationkey n,n_name s,n_regionkey n",
}
PROFILED = ("customer", "events", "lineitem", "orders", "part", "supplier")


def columns(table: str) -> list[tuple[int, str, str]]:
    return [(i, *entry.split()) for i, entry in enumerate(COLUMNS[table].split(","))]


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# Sources and catalog


def _ingested(table_name: str) -> str:
    return f"""
SELECT o_orderpriority, count(*) AS orders, CAST(sum(o_custkey) AS BIGINT) AS customers,
       round(sum(o_totalprice), 2) AS price, CAST(min(o_orderdate) AS VARCHAR) AS first_date,
       (SELECT count(*) FROM orders) AS row_count, '{table_name}' AS table_name
FROM orders GROUP BY 1"""


ORACLE["ingest_csv"] = _ingested("orders_from_csv")
ORACLE["ingest_parquet"] = _ingested("orders_from_parquet")
ORACLE["describe_table"] = union(
    [
        f"""SELECT {i} AS ordinal, '{name}' AS "column", (SELECT string_agg(v, '|' ORDER BY v) FROM (
  SELECT DISTINCT CAST({name} AS VARCHAR) AS v FROM {table} WHERE {name} IS NOT NULL ORDER BY v LIMIT 3)) AS samples,
  '{table}' AS table_name"""
        for table in ("customer", "part", "nation", "orders")
        for i, name, _ in columns(table)
    ]
)
ORACLE["preview"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate,
       o_orderpriority, (SELECT count(*) FROM orders) AS row_count,
       CAST((SELECT count(*) FROM orders) > 20 AS INTEGER) AS truncated
FROM orders ORDER BY o_orderkey LIMIT 20"""
ORACLE["catalog_upsert"] = """
WITH e AS (
  SELECT 'set ' || user_id AS dataset_name, event_type AS table_name, props AS source_path, event_id AS seq FROM events
  UNION ALL
  SELECT 'set ' || o_custkey, o_orderpriority, o_orderstatus, o_orderkey + 10000000000 FROM orders)
SELECT dataset_name, table_name, source_path, seq FROM e
QUALIFY row_number() OVER (PARTITION BY dataset_name ORDER BY seq DESC) = 1"""

# Profile

GAPS = """gaps AS (SELECT l_orderkey, nullif(l_linenumber, 1) AS l_linenumber,
  CASE WHEN l_quantity > 25 THEN l_quantity END AS l_quantity, nullif(l_returnflag, 'A') AS l_returnflag,
  nullif(l_linestatus, 'F') AS l_linestatus, l_shipdate FROM lineitem)"""
GAP_COLUMNS = ("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")

ORACLE["profile_nulls"] = f"WITH {GAPS}\n" + union(
    [
        f"""SELECT {i} AS ordinal, '{name}' AS "column", count(*) AS row_count, count(*) - count({name}) AS null_count,
  round((count(*) - count({name})) / count(*), 6) AS null_rate FROM gaps"""
        for i, name in enumerate(GAP_COLUMNS)
    ]
)


ORACLE["profile_distinct"] = union(
    [
        f"""SELECT '{name}' AS "column", count(DISTINCT {name}) AS distinct_count, '{table}' AS table_name FROM {table}"""
        for table in PROFILED
        for _, name, _ in columns(table)
    ]
)


def _top_values(table: str, name: str) -> str:
    return f"""SELECT * FROM (
  SELECT '{name}' AS "column", CAST({name} AS VARCHAR) AS "value", count(*) AS "count",
         CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({name} AS VARCHAR)) AS INTEGER) AS place,
         '{table}' AS table_name
  FROM {table} WHERE {name} IS NOT NULL GROUP BY 2)
WHERE place <= 5"""


ORACLE["profile_top_values"] = union(
    [_top_values(table, name) for table in ("part", "orders") for _, name, _ in columns(table)]
)


def _numeric(table: str, name: str) -> str:
    v = f"CAST({name} AS DOUBLE)"
    return (
        f"round(min({v}), 6) AS \"min\", round(max({v}), 6) AS \"max\", round(avg({v}), 6) AS mean, "
        f"round(median({v}), 6) AS median, round(stddev_samp({v}), 6) AS stddev"
    )


ORACLE["profile_numeric"] = union(
    [
        f"""SELECT '{name}' AS "column", {_numeric("lineitem", name)} FROM lineitem"""
        for _, name, kind in columns("lineitem")
        if kind == "n"
    ]
)


def _role(table: str, name: str, kind: str) -> str:
    if kind == "t" or any(word in name for word in ("date", "time", "_at")):
        return "CASE WHEN count(*) >= 0 THEN 'time' END"
    if name == "id" or name.endswith("_id"):
        return "CASE WHEN count(*) >= 0 THEN 'id' END"
    rest = "'measure'" if kind == "n" else "'dimension'"
    unique = f"count(*) > 20 AND count(DISTINCT {name}) / count(*) > 0.98"
    return f"CASE WHEN {unique} THEN 'id' ELSE {rest} END"


def _roles(table: str) -> str:
    return union(
        [
            f"""SELECT {i} AS ordinal, '{name}' AS "column", {_role(table, name, kind)} AS role,
  '{table}' AS table_name FROM {table}"""
            for i, name, kind in columns(table)
        ]
    )


ROLES = "roles AS (" + union([_roles(table) for table in PROFILED]) + ")"

ORACLE["profile_roles"] = f"WITH {ROLES} SELECT * FROM roles"
ORACLE["profile_date_range"] = """
WITH d AS (SELECT o_orderdate, o_orderdate + INTERVAL 30 DAY AS due_date FROM orders)
SELECT 'o_orderdate' AS "column", CAST(min(o_orderdate) AS VARCHAR) AS date_min,
       CAST(max(o_orderdate) AS VARCHAR) AS date_max FROM d
UNION ALL SELECT 'due_date', CAST(min(due_date) AS VARCHAR), CAST(max(due_date) AS VARCHAR) FROM d
UNION ALL SELECT '*', CAST(min(due_date) AS VARCHAR), CAST(max(due_date) AS VARCHAR) FROM d"""


def _names(role: str) -> str:
    return f"""coalesce(string_agg("column", ',' ORDER BY ordinal) FILTER (role = '{role}'), '') AS {role}_columns"""


ORACLE["profile_candidates"] = f"""WITH {ROLES}
SELECT {_names("time")}, {_names("dimension")}, {_names("measure")}, table_name FROM roles GROUP BY table_name"""


def _profile_row(i: int, name: str, kind: str) -> str:
    numbers = ", ".join(
        f'CAST(NULL AS DOUBLE) AS "{part}"' for part in ("min", "max", "mean", "median", "stddev")
    )
    if kind == "n":
        numbers = _numeric("orders", name)
    dates = f"CAST(min({name}) AS VARCHAR) AS date_min, CAST(max({name}) AS VARCHAR) AS date_max"
    if kind != "t":
        dates = "CAST(NULL AS VARCHAR) AS date_min, CAST(NULL AS VARCHAR) AS date_max"
    return f"""SELECT {i} AS ordinal, '{name}' AS "column", {_role("orders", name, kind)} AS role,
  count(*) AS row_count, round((count(*) - count({name})) / count(*), 6) AS null_rate,
  count(DISTINCT {name}) AS distinct_count, {numbers},
  (SELECT string_agg("value" || ':' || "count", '|' ORDER BY place) FROM ({_top_values("orders", name)})) AS top_values,
  {dates} FROM orders"""


ORACLE["profile_dataset"] = union([_profile_row(*entry) for entry in columns("orders")])

# Semantic layer

PLACED = f"""WITH {ROLES}, placed AS (SELECT *, CAST(row_number() OVER (
  PARTITION BY table_name, role ORDER BY ordinal) AS INTEGER) AS place FROM roles)"""

ORACLE["semantic_metrics"] = f"""{PLACED}
SELECT place, 'total_' || "column" AS name, 'SUM(' || "column" || ')' AS sql, 'Total ' || "column" AS description,
       CAST(0.8 AS DOUBLE) AS confidence, table_name
FROM placed WHERE role = 'measure'"""
ORACLE["semantic_dimensions"] = f"""{PLACED}
SELECT "column" AS name, "column", CAST(NULL AS VARCHAR) AS grain, 'Dimension based on ' || "column" AS description,
       CAST(0.85 AS DOUBLE) AS confidence, table_name
FROM placed WHERE role = 'dimension'
UNION ALL
SELECT "column", "column", 'day', 'Time dimension on ' || "column", CAST(0.9 AS DOUBLE), table_name
FROM placed WHERE role = 'time' AND place = 1"""
ORACLE["semantic_validate"] = r"""
WITH m AS (SELECT 'total_' || event_id AS name, CASE event_id % 7 WHEN 0 THEN 'SUM(value)' WHEN 1 THEN 'avg( value )'
             WHEN 2 THEN 'COUNT(*)' WHEN 3 THEN 'SUM(nothing)' WHEN 4 THEN 'MEDIAN(value)'
             WHEN 5 THEN 'SUM(value) + 1' ELSE 'max(*)' END AS sql, event_id FROM events),
     words AS (SELECT DISTINCT word FROM (
       SELECT unnest(regexp_extract_all(rule, '\b[a-zA-Z_][a-zA-Z0-9_]*\b')) AS word FROM (
         SELECT 'Prefer total_' || event_id * 2 || ' over dim_d' || event_id * 3 || ' and total' AS rule FROM events)))
SELECT 'unsafe_metric' AS kind, name, sql AS detail FROM m WHERE event_id % 7 IN (4, 5, 6)
UNION ALL SELECT 'unknown_metric_column', name, 'nothing' FROM m WHERE event_id % 7 = 3
UNION ALL SELECT 'unknown_dimension_column', 'd' || event_id, 'missing' FROM events WHERE event_type = 'error'
UNION ALL SELECT 'unknown_time_column', 'ts', 'ts'
UNION ALL SELECT 'unknown_rule_reference', word, word FROM words
  WHERE (starts_with(word, 'total_') AND word NOT IN (SELECT name FROM m))
     OR (starts_with(word, 'dim_') AND substr(word, 6) NOT IN (SELECT CAST(event_id AS VARCHAR) FROM events))"""
ORACLE["metric_sum"] = "SELECT round(sum(l_quantity), 6) AS metric_value FROM lineitem"
ORACLE["metric_avg"] = "SELECT round(avg(l_quantity), 6) AS metric_value FROM lineitem"
ORACLE["metric_min"] = "SELECT round(min(l_extendedprice), 6) AS metric_value FROM lineitem"
ORACLE["metric_max"] = "SELECT round(max(l_extendedprice), 6) AS metric_value FROM lineitem"
ORACLE["metric_count"] = "SELECT CAST(count(*) AS DOUBLE) AS metric_value FROM lineitem"
ORACLE["explain_metric"] = f"""{PLACED}
SELECT 'total_' || "column" AS metric_name, 'Total ' || "column" AS description, 'SUM(' || "column" || ')' AS sql,
       (SELECT string_agg("column", ',' ORDER BY ordinal) FROM placed
        WHERE table_name = 'lineitem' AND role = 'dimension') AS dimensions_commonly_used
FROM placed WHERE table_name = 'lineitem' AND role = 'measure'"""

# Overview

ORACLE["overview_headline"] = """
WITH v AS (SELECT 'total_l_quantity' AS metric, sum(l_quantity) AS v FROM lineitem
           UNION ALL SELECT 'mean_l_discount', avg(l_discount) FROM lineitem
           UNION ALL SELECT 'rows', CAST(count(*) AS DOUBLE) FROM lineitem
           UNION ALL SELECT 'top_l_tax', max(l_tax) FROM lineitem)
SELECT metric, round(v, 6) AS "value", round(least(1.0, abs(v) / 1000), 6) AS impact FROM v"""
ORACLE["overview_date_coverage"] = """
SELECT CAST(min(l_shipdate) AS VARCHAR) AS min_date, CAST(max(l_shipdate) AS VARCHAR) AS max_date FROM lineitem"""

SUPPLIERS = """t AS (SELECT l_suppkey AS segment, sum(l_quantity) AS v FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY v DESC, segment) AS place FROM t)"""

ORACLE["overview_top_segments"] = f"""
WITH {SUPPLIERS} SELECT place, segment, round(v, 6) AS "value" FROM r WHERE place <= 10"""
ORACLE["overview_concentration"] = f"""
WITH {SUPPLIERS}, s AS (SELECT max(v) AS top, sum(v) AS total FROM r)
SELECT round(top, 6) AS top_value, round(total, 6) AS total, round(top / total, 6) AS top_share,
       CASE WHEN top / total >= 0.5 THEN 'high' ELSE 'medium' END AS severity FROM s"""

# Series, trends, anomalies


def period_series(grain: str, by: str = "", table: str = "lineitem", value: str = "l_quantity", time: str = "l_shipdate") -> str:
    keys = f"{by}, " if by else ""
    over = f"PARTITION BY {by} " if by else ""
    return f"""s AS (SELECT {keys}date_trunc('{grain}', {time}) AS p, sum({value}) AS v FROM {table} GROUP BY ALL),
o AS (SELECT *, row_number() OVER ({over}ORDER BY p) AS place, lag(v) OVER ({over}ORDER BY p) AS pv,
      count(*) OVER ({over}) AS n, avg(v) OVER ({over}) AS mu, stddev_pop(v) OVER ({over}) AS sd,
      median(v) OVER ({over}) AS md FROM s),
k AS (SELECT *, median(abs(v - md)) OVER ({over}) AS mad, v - pv AS d, CASE WHEN pv <> 0 THEN (v - pv) / pv END AS rd,
      CASE WHEN sd = 0 THEN 0 ELSE (v - mu) / sd END AS z FROM o),
a AS (SELECT *, CASE WHEN mad = 0 THEN 0 ELSE 0.6745 * (v - md) / mad END AS ms FROM k)"""


WEEK = period_series("week")

for _grain in ("day", "week", "month", "quarter", "year"):
    ORACLE[f"series_{_grain}"] = f"""
WITH {period_series(_grain)} SELECT CAST(p AS TIMESTAMP)::VARCHAR AS period, round(v, 6) AS "value" FROM a"""

ORACLE["trend_deltas"] = f"""
WITH {WEEK} SELECT CAST(p AS TIMESTAMP)::VARCHAR AS period, round(d, 6) AS delta, round(rd, 6) AS relative_delta
FROM a WHERE place > 1"""
ORACLE["trend_max_increase"] = f"""
WITH {WEEK} SELECT CAST(p AS TIMESTAMP)::VARCHAR AS max_increase_period, round(d, 6) AS max_increase,
  round(least(1.0, abs(d) / (abs((SELECT v FROM a ORDER BY place DESC LIMIT 1)) + 1)), 6) AS increase_impact
FROM a WHERE place > 1 ORDER BY d DESC, place LIMIT 1"""
ORACLE["trend_max_decrease"] = f"""
WITH {WEEK} SELECT CAST(p AS TIMESTAMP)::VARCHAR AS max_decrease_period, round(d, 6) AS max_decrease,
  round(least(1.0, abs(d) / (abs((SELECT v FROM a ORDER BY place DESC LIMIT 1)) + 1)), 6) AS decrease_impact
FROM a WHERE place > 1 ORDER BY d, place LIMIT 1"""
ORACLE["trend_volatility"] = f"""
WITH {WEEK} SELECT count(*) AS periods, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation,
  round(stddev_pop(v) / abs(avg(v)), 6) AS volatility_ratio FROM a"""
ORACLE["trend_spikes"] = f"""
WITH {WEEK} SELECT CAST(p AS TIMESTAMP)::VARCHAR AS period, round(v, 6) AS "value", round(z, 6) AS z_score
FROM a WHERE n > 2 AND sd > 0 AND abs(z) >= 2.0"""
ORACLE["trend_by_supplier"] = f"""
WITH {period_series("month", "l_suppkey")}
SELECT l_suppkey, count(*) AS periods, round(arg_max(v, place), 6) AS last_value, round(max(d), 6) AS max_increase,
  CAST(CAST(min(p) FILTER (d = md_) AS TIMESTAMP) AS VARCHAR) AS max_increase_period,
  round(min(d), 6) AS max_decrease,
  CAST(CAST(min(p) FILTER (d = mi_) AS TIMESTAMP) AS VARCHAR) AS max_decrease_period,
  round(CASE WHEN avg(v) = 0 THEN 0 ELSE stddev_pop(v) / abs(avg(v)) END, 6) AS volatility_ratio,
  count(*) FILTER (n > 2 AND sd > 0 AND abs(z) >= 2.0) AS spikes
FROM (SELECT *, max(d) OVER (PARTITION BY l_suppkey) AS md_, min(d) OVER (PARTITION BY l_suppkey) AS mi_ FROM a)
GROUP BY 1"""
ORACLE["anomaly_scores"] = f"""
WITH {period_series("day", "event_type", "events", "value", "ts")}
SELECT event_type, CAST(p AS TIMESTAMP)::VARCHAR AS period, round(v, 4) AS "value", round(z, 6) AS z_score,
       round(ms, 6) AS mad_score, round(d, 4) AS absolute_delta, round(rd, 6) AS relative_delta, n AS periods FROM a"""
ORACLE["anomaly_flags"] = f"""
WITH {WEEK} SELECT CAST(p AS TIMESTAMP)::VARCHAR AS period, round(v, 6) AS "value", round(z, 6) AS z_score,
  round(ms, 6) AS mad_score, round(d, 6) AS absolute_delta, round(rd, 6) AS relative_delta
FROM a WHERE n >= 4 AND (abs(z) >= 2.5 OR abs(ms) >= 3.5)"""
ORACLE["anomaly_summary"] = f"""
WITH {period_series("month", "l_suppkey")},
c AS (SELECT l_suppkey, count(*) AS periods, count(*) FILTER (n >= 4 AND (abs(z) >= 2.5 OR abs(ms) >= 3.5)) AS anomalies
      FROM a GROUP BY 1)
SELECT *, CASE WHEN anomalies >= 2 THEN 'persistent' WHEN anomalies = 1 THEN 'one-off' ELSE 'none' END AS pattern,
  CASE WHEN anomalies >= 2 THEN 'high' WHEN anomalies = 1 THEN 'medium' ELSE 'low' END AS severity,
  round(anomalies / periods, 6) AS share FROM c"""

# Segments

SUPPLIER_SUMMARY = f"""{SUPPLIERS}, q AS (SELECT sum(v) AS total, sum(v) FILTER (place <= 10) AS top, count(*) AS n,
  sum(v * v) AS sq, arg_min(segment, place) AS winner, arg_min(v, place) AS wv,
  arg_max(segment, place) FILTER (place <= 10) AS loser, arg_max(v, place) FILTER (place <= 10) AS lv FROM r)"""

ORACLE["segment_ranking"] = f"""WITH {SUPPLIERS} SELECT place, segment, round(v, 6) AS "value" FROM r"""
ORACLE["segment_leader"] = f"""
WITH {SUPPLIER_SUMMARY} SELECT CAST(winner AS VARCHAR) AS winner, round(wv, 6) AS winner_value,
  round(total, 6) AS total, round(least(1.0, wv / (total + 1)), 6) AS leader_impact FROM q"""
ORACLE["segment_long_tail"] = f"""
WITH {SUPPLIER_SUMMARY} SELECT round(total, 6) AS total, round(top, 6) AS top_total,
  round(CASE WHEN total = 0 THEN 0 ELSE (total - top) / total END, 6) AS long_tail_share FROM q"""
ORACLE["segment_hhi"] = f"""
WITH {SUPPLIERS}, q AS (SELECT sum(v) AS total, count(*) AS n FROM r)
SELECT (SELECT n FROM q) AS segments, round(sum(power(v / (SELECT total FROM q), 2)), 6) AS concentration FROM r"""
ORACLE["segment_spread"] = f"""
WITH {SUPPLIER_SUMMARY} SELECT CAST(winner AS VARCHAR) AS winner, CAST(loser AS VARCHAR) AS loser,
  round(wv - lv, 6) AS spread, round(least(1.0, abs(wv - lv) / (abs(wv) + 1)), 6) AS spread_impact FROM q"""
ORACLE["segment_all_parts"] = """
WITH t AS (SELECT l_partkey AS segment, sum(l_quantity) AS v FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY v DESC, segment) AS place, sum(v) OVER () AS total FROM t)
SELECT count(*) AS segments, round(max(total), 6) AS total,
  round((max(total) - sum(v) FILTER (place <= 10)) / max(total), 6) AS long_tail_share,
  round(sum(power(v / total, 2)), 9) AS concentration, CAST(arg_min(segment, place) AS VARCHAR) AS winner,
  CAST(arg_max(segment, place) FILTER (place <= 10) AS VARCHAR) AS loser,
  round(max(v) - min(v) FILTER (place <= 10), 6) AS spread FROM r"""
ORACLE["segment_by_flag"] = """
WITH t AS (SELECT l_returnflag, l_suppkey AS segment, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY v DESC, segment) AS place FROM t),
r AS (SELECT *, sum(v) OVER (PARTITION BY l_returnflag) AS total FROM p)
SELECT l_returnflag, count(*) AS segments, round(max(total), 6) AS total,
  CAST(arg_min(segment, place) AS VARCHAR) AS winner,
  CAST(arg_max(segment, place) FILTER (place <= 10) AS VARCHAR) AS loser,
  round((max(total) - sum(v) FILTER (place <= 10)) / max(total), 6) AS long_tail_share,
  round(sum(power(v / total, 2)), 6) AS concentration,
  round(max(v) - min(v) FILTER (place <= 10), 6) AS spread FROM r GROUP BY 1"""

# Diagnostics

MISSING = f"WITH {GAPS}, m AS (" + union(
    [
        f"""SELECT {i} AS ordinal, '{name}' AS "column", count(*) - count({name}) AS null_count,
  round((count(*) - count({name})) / count(*), 9) AS null_rate FROM gaps"""
        for i, name in enumerate(GAP_COLUMNS)
    ]
) + ")"

ORACLE["diag_missingness"] = f"{MISSING} SELECT * FROM m"
ORACLE["diag_worst_missing"] = f"""{MISSING}
SELECT ordinal, "column", null_rate FROM m ORDER BY null_rate DESC, ordinal LIMIT 3"""
ORACLE["diag_cardinality"] = union(
    [
        f"""SELECT '{name}' AS dimension, count(DISTINCT {name}) AS distinct_count,
  round(count(DISTINCT {name}) / count(*), 9) AS cardinality_ratio,
  CAST(count(DISTINCT {name}) / count(*) > 0.8 AS INTEGER) AS near_unique FROM events"""
        for name in ("event_id", "user_id", "event_type", "props", "ts")
    ]
)
ORACLE["diag_instability"] = "WITH c AS (" + union(
    [
        f"""SELECT '{name}' AS dimension, date_trunc('month', l_shipdate) AS p, count(DISTINCT {name}) AS n
  FROM lineitem GROUP BY 2"""
        for name in ("l_returnflag", "l_linestatus", "l_suppkey", "l_partkey", "l_shipdate")
    ]
) + """)
SELECT dimension, max(n) AS max_count, min(n) AS min_count,
  round(CASE WHEN min(n) > 0 THEN max(n) / min(n) ELSE max(n) END, 6) AS explosion_ratio,
  CAST(CASE WHEN min(n) > 0 THEN max(n) / min(n) ELSE max(n) END >= 3.0 AS INTEGER) AS unstable
FROM c GROUP BY 1"""
ORACLE["diag_duplicate_keys"] = """
WITH d AS (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents WHERE lang = 'en')
SELECT 'doc_id' AS "key", count(*) - count(DISTINCT doc_id) AS duplicate_count, count(*) AS row_count FROM d"""

# Findings

SCORED = r"""c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f
  FROM orders GROUP BY ALL),
raw AS (SELECT 'customer ' || o_custkey AS dataset_name, ascii(o_orderpriority) AS task_no,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Delivery risk ' ELSE 'Orders ' END || o_orderpriority AS title,
  CASE WHEN n >= 5 THEN 'Found ' || n || ' orders, sales of -' || f || '.5 per year'
       WHEN f > 0 THEN 'Finished orders only' ELSE n || ' open, at risk: ' || n * 20 END AS observation,
  CASE WHEN f > 1 THEN 'total_orders' END AS metric,
  CASE WHEN n % 3 = 0 THEN 0 ELSE least(1.0, n / 8) END AS i0, CASE WHEN f = 1 THEN 0 ELSE f / 5 END AS c0,
  CASE WHEN n % 2 = 0 THEN 0 ELSE 0.6 END AS b0, f % 4 AS caveat_count, n > 3 AS has_evidence FROM c),
derived AS (SELECT *,
  CASE WHEN i0 > 0 THEN i0 WHEN NOT regexp_matches(observation, '\d') THEN 0.3 ELSE least(1.0, list_max(list_transform(
    regexp_extract_all(observation, '-?\d+(?:\.\d+)?'), lambda x: abs(CAST(x AS DOUBLE)))) / 100.0) END AS i1,
  CASE WHEN c0 > 0 THEN c0 ELSE greatest(0.1, CASE WHEN has_evidence THEN 0.75 ELSE 0.4 END
    - least(0.3, 0.08 * caveat_count)) END AS c1,
  CASE WHEN b0 > 0 THEN b0 ELSE least(1.0, 0.5 + CASE WHEN metric IS NOT NULL THEN 0.2 ELSE 0 END
    + CASE WHEN contains(lower(title), 'risk') OR contains(lower(observation), 'risk') THEN 0.15 ELSE 0 END
    + CASE WHEN contains(observation, 'sales') THEN 0.1 ELSE 0 END) END AS b1 FROM raw),
scored AS (SELECT *, CAST(least(1.0, greatest(0.0, i1)) AS DOUBLE) AS i, CAST(least(1.0, greatest(0.0, c1)) AS DOUBLE) AS cf,
  CAST(least(1.0, greatest(0.0, b1)) AS DOUBLE) AS b FROM derived),
total AS (SELECT *, i * CAST(0.45 AS DOUBLE) + cf * CAST(0.35 AS DOUBLE) + b * CAST(0.20 AS DOUBLE) AS combined FROM scored),
ranked AS (SELECT *, CASE WHEN combined >= 0.7 THEN 'high' WHEN combined >= 0.4 THEN 'medium' ELSE 'low' END AS severity,
  row_number() OVER (PARTITION BY dataset_name ORDER BY round(combined, 12) DESC, task_no) AS "rank" FROM total)"""

ORACLE["score_findings"] = f"""
WITH {SCORED} SELECT dataset_name, title, round(i, 6) AS impact_score, round(cf, 6) AS confidence_score,
  round(b, 6) AS business_relevance_score, round(combined, 6) AS combined_score, severity FROM ranked"""
ORACLE["rank_findings"] = f"""
WITH {SCORED} SELECT dataset_name, title, round(combined, 6) AS combined_score, "rank" FROM ranked"""
ORACLE["executive_summary"] = f"""
WITH {SCORED} SELECT dataset_name, min(title) FILTER ("rank" = 1) AS headline,
  string_agg(title, '|' ORDER BY "rank") FILTER ("rank" <= 3) AS top_findings,
  coalesce(string_agg(observation, '|' ORDER BY "rank") FILTER ("rank" <= 3 AND severity = 'high'), '') AS key_risks,
  CASE WHEN sum(caveat_count) FILTER ("rank" <= 3) = 0 THEN 'Summary is constrained to deterministic evidence only.'
    ELSE array_to_string(list_slice(flatten(list(list_slice(['a', 'b', 'c'], 1, caveat_count) ORDER BY "rank")
      FILTER ("rank" <= 3)), 1, 5), '|') END AS caveats,
  string_agg('Validate drivers behind: ' || title, '|' ORDER BY "rank") FILTER ("rank" <= 2) AS follow_up_questions
FROM ranked GROUP BY 1"""

# Guarded SQL

LOG = r"""log AS (SELECT event_id AS id, CASE event_id % 10
  WHEN 0 THEN 'SELECT * FROM orders LIMIT ' || event_id
  WHEN 1 THEN 'DROP TABLE t' || event_id
  WHEN 2 THEN 'SELECT ' || event_id || '; SELECT 2'
  WHEN 3 THEN '  ```sql' || chr(10) || 'SELECT a FROM main.orders o JOIN Customer c ON 1 = 1 -- ' || event_id || chr(10) || '```'
  WHEN 4 THEN 'sql with x as (select ' || event_id || ') select * from x;'
  WHEN 5 THEN 'SELECT 1 /* delete' || chr(10) || event_id || ' */ FROM secret_table limit 5000'
  WHEN 6 THEN 'select replace(a, ''b'', ''' || event_id || ''') from information_schema.tables'
  WHEN 7 THEN '-- nothing'
  WHEN 8 THEN 'UPDATE orders SET a = ' || event_id || ';'
  ELSE 'SELECT o_orderkey FROM orders WHERE o_orderkey = ' || event_id || ';;' END AS sql FROM events)"""
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def trim(text: str) -> str:
    return TRIM.format(text)


def _normalized(text: str) -> str:
    for pattern, options in (("^```sql", "i"), ("^```", "c"), (r"```\z", "c"), ("^sql ", "i")):
        text = f"regexp_replace({trim(text)}, '{pattern}', '', '{options}')"
    return trim(text)


CLEAN = trim(r"regexp_replace(regexp_replace(sql, '--[^\n]*', '', 'g'), '/\*.*?\*/', '', 'gs')")
AUDITED = (
    f"{LOG}, clean AS (SELECT id, {CLEAN} AS q FROM log), "
    r"refs AS (SELECT id, q, lower(q) AS l, list_sort(list_distinct(list_transform(regexp_extract_all(lower(q), "
    r"'\b(?:from|join)\s+([a-zA-Z_][\w\.]*)', 1), lambda x: string_split(x, '.')[-1]))) AS t FROM clean)"
)
WORDS = ("insert", "update", "delete", "drop", "alter", "truncate", "grant", "revoke", "create", "replace")
SYSTEM = ("sqlite_master", "information_schema", "pg_catalog")
ERRORS = ", ".join(
    [
        r"CASE WHEN contains(regexp_replace(q, '\s*;$', ''), ';') THEN 'Multiple statements are not allowed' END",
        "CASE WHEN NOT regexp_matches(l, '^(select|with)') THEN 'Only SELECT/CTE queries are allowed' END",
        *[rf"CASE WHEN regexp_matches(l, '\b{w}\b') THEN 'Forbidden keyword detected: {w}' END" for w in WORDS],
        *[rf"CASE WHEN regexp_matches(l, '\b{w}\b') THEN 'System table/schema access blocked: {w}' END" for w in SYSTEM],
        "CASE WHEN list_contains(t, 'secret_table') THEN 'Forbidden table referenced: secret_table' END",
        "CASE WHEN len(list_filter(t, lambda x: x NOT IN ('orders', 'customer'))) > 0 THEN 'Disallowed table(s) referenced: '"
        " || array_to_string(list_filter(t, lambda x: x NOT IN ('orders', 'customer')), ', ') || '. Use only allowed_tables.' END",
    ]
)

ORACLE["sql_normalize"] = f"WITH {LOG} SELECT id, {_normalized('sql')} AS normalized_sql FROM log"
ORACLE["sql_limit"] = rf"""
WITH {LOG}, l AS (SELECT id, sql, TRY_CAST(regexp_extract(sql, '\blimit\s+(\d+)\b', 1, 'i') AS BIGINT) AS n FROM log)
SELECT id, CASE WHEN n IS NULL THEN regexp_replace(sql, ';+$', '') || ' LIMIT 50'
    WHEN n > 1000 THEN regexp_replace(sql, '\blimit\s+\d+\b', 'LIMIT 1000', 'i') ELSE sql END AS limited_sql,
  CAST(n IS NULL OR n > 1000 AS INTEGER) AS rewritten,
  CASE WHEN n > 1000 THEN 'LIMIT ' || n || ' capped to max_row_limit=1000' END AS warning FROM l"""
ORACLE["sql_table_refs"] = f"WITH {AUDITED} SELECT id, array_to_string(t, ',') AS table_refs FROM refs"
ORACLE["sql_audit"] = f"""
WITH {AUDITED}, e AS (SELECT id, q, CASE WHEN q = '' THEN ['SQL is empty']
  ELSE list_filter([{ERRORS}], lambda x: x IS NOT NULL) END AS errors FROM refs)
SELECT id, q AS checked_sql, array_to_string(errors, '; ') AS errors, CAST(len(errors) = 0 AS INTEGER) AS passed FROM e"""
ORACLE["guarded_sql"] = """
SELECT o_custkey, count(*) AS order_count, round(sum(o_totalprice), 2) AS total_price FROM orders
GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 25"""

# Results

ORACLE["result_top_insight"] = f"""
WITH {SUPPLIERS}, b AS (SELECT count(*) AS n, arg_min(segment, place) AS segment, CAST(max(v) AS BIGINT) AS v FROM r)
SELECT n AS row_count, 'total_quantity' AS top_metric, CAST(v AS DOUBLE) AS metric_value,
  'segment=' || segment AS dimension_label,
  'Answer to ''Which supplier ships most?'': returned ' || n || ' rows in 0 ms. Top insight: segment=' || segment
  || ' leads on total_quantity with ' || v || '. Result preview represents full returned rows.' AS insight FROM b"""
ORACLE["chart_series"] = f"""
WITH {period_series("quarter")}
SELECT 'line' AS hint, CAST(CAST(p AS DATE) AS VARCHAR) AS label, round(v, 6) AS "value" FROM a"""

# Conversations

MESSAGES = """msg AS (SELECT user_id AS session, event_id AS seq, CASE event_type
  WHEN 'view' THEN 'show top customers by revenue' WHEN 'click' THEN 'filter that to one row'
  WHEN 'purchase' THEN 'what sql did you use previously?' WHEN 'signup' THEN 'hello there'
  ELSE 'summarize the takeaway' END || ' #' || event_id AS text, 'SELECT ' || event_id AS sql FROM events)"""


def modes(source: str, session: str, seq: str, text: str) -> str:
    def has(words: str) -> str:
        return f"regexp_matches(lower({text}), '{words}')"

    last_sql = f"{has('sql|query')} AND {has('last|previous|that|generated|used|use|show')}"
    summary = has("summary|summarize|takeaway|recommend|recommendation|insight")
    data = has(
        "top|count|sum|avg|average|revenue|sales|customer|orders|list|show|compare|trend|how many|what|which"
    )
    follow_up = has("that|those|them|same|again|previous|above")
    before = f"OVER (PARTITION BY {session} ORDER BY {seq} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""flags AS (SELECT *, ({last_sql}) AS meta, ({summary}) AS summ, ({data}) AS data, ({follow_up}) AS fu
  FROM {source}),
prior AS (SELECT *, coalesce(bool_or(NOT meta AND NOT summ AND data) {before}, false) AS asked FROM flags),
moded AS (SELECT *, CASE WHEN {trim(text)} = '' THEN 'error' WHEN meta THEN 'meta' WHEN summ THEN 'chat'
  WHEN data OR (fu AND asked) THEN 'query' ELSE 'chat' END AS mode FROM prior),
found AS (SELECT *, last_value(CASE WHEN mode = 'query' THEN {text} END IGNORE NULLS) {before} AS pq FROM moded)"""


FOUND = f"{MESSAGES}, {modes('msg', 'session', 'seq', 'text')}"
PREVIOUS_SQL = """last_value(CASE WHEN mode = 'query' THEN sql END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
REPLY = """CASE mode WHEN 'meta' THEN CASE WHEN pq IS NULL THEN 'No previous SQL in this session yet.'
    ELSE 'Here is the SQL from your previous query.' END
  WHEN 'chat' THEN CASE WHEN pq IS NULL THEN 'I can help you analyze your data. Ask a question like '
    || '''Top customers by revenue in the last 30 days''. No semantic metadata loaded.'
    ELSE 'I can continue from the last result. Ask for filters, breakdowns, comparisons, or ask for the previous SQL.' END
  END"""
TURNS = """turns AS (SELECT u.conv_id, u.turn, u.text AS "user", a.text AS assistant FROM conversations u
  LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user')"""

ORACLE["conv_modes"] = f"WITH {FOUND} SELECT session, seq, mode FROM found"
ORACLE["conv_modes_log"] = f"""
WITH users AS (SELECT * FROM conversations WHERE role = 'user'), {modes("users", "conv_id", "turn", "text")}
SELECT conv_id, turn, mode FROM found"""
ORACLE["conv_previous_query"] = f"""
WITH {FOUND} SELECT session, seq, mode, pq AS previous_query, {PREVIOUS_SQL} AS previous_sql, {REPLY} AS reply FROM found"""
ORACLE["conv_query_replies"] = """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'I ran the query successfully, but it returned no rows.'
  ELSE 'Found ' || event_id || '.'
    || CASE event_type WHEN 'view' THEN ' First row preview: {view}' WHEN 'click' THEN ' First row preview: {click}' ELSE '' END
    || ' Suggested follow-ups: '
    || CASE event_type WHEN 'view' THEN 'break down units by region; compare units vs previous period'
       ELSE 'break down revenue by category; compare revenue vs previous period' END END AS reply FROM events"""
ORACLE["conv_follow_up"] = f"""
WITH {FOUND}, p AS (SELECT *, {PREVIOUS_SQL} AS ps FROM found)
SELECT session, seq, CASE WHEN mode = 'query' AND fu AND pq IS NOT NULL THEN
  'Use this previous context to resolve references.' || chr(10) || 'Previous question: ' || pq || chr(10)
  || 'Previous SQL: ' || ps || chr(10) || 'Follow-up question: ' || text ELSE text END AS resolved FROM p"""
ORACLE["conv_history"] = f"""
WITH {TURNS}, h AS (SELECT conv_id, turn, list('User: ' || "user" || chr(10) || 'Assistant: ' || coalesce(assistant, 'None'))
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS t FROM turns)
SELECT conv_id, turn, CASE WHEN coalesce(len(t), 0) = 0 THEN 'No previous turns.' ELSE array_to_string(t, chr(10)) END
  AS history FROM h"""


def _note(session: str, at: str, user: str, assistant: str) -> str:
    nl = "chr(10)"
    return f"""CASE WHEN row_number() OVER (PARTITION BY {session} ORDER BY {at}) = 1 THEN '# Conversation Notes: '
  || {session} || {nl} || {nl} || '_Created: ' || {at} || '_' || {nl} || {nl} ELSE '' END
  || '## Turn (' || {at} || ')' || {nl} || {nl} || '- Mode: `' || mode || '`' || {nl} || '- User: ' || {user} || {nl} || {nl}
  || '### Assistant' || {nl} || {nl} || coalesce({assistant}, '') || {nl} || {nl}"""


ORACLE["conv_notes"] = f"""
WITH {TURNS}, {modes("turns", "conv_id", "turn", '"user"')}
SELECT conv_id, conv_id || '.md' AS file_name, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no,
  {_note("conv_id", "turn", '"user"', "assistant")} AS note FROM found"""
ORACLE["conv_notes_events"] = f"""
WITH {FOUND}, n AS (SELECT '.team/' || session || ' review.' AS name, session AS id, seq, text, mode, sql, {REPLY} AS reply FROM found)
SELECT name AS session, 'team_' || id || '_review.md' AS file_name,
  row_number() OVER (PARTITION BY name ORDER BY seq) AS turn_no,
  {_note("name", "seq", "text", "reply")} || CASE WHEN mode = 'query' THEN '### SQL' || chr(10) || chr(10) || '```sql'
    || chr(10) || sql || chr(10) || '```' || chr(10) || chr(10) ELSE '' END AS note FROM n"""

# Reports over the line items: every finding with its scores. Metrics are the sums of the first measures.

REPORT_METRICS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
REPORT_DIMENSIONS = ("l_returnflag", "l_linestatus", "l_shipdate")


def _finding(task: int, number: str, title: str, metric: str, dimensions: str, query_id: str, impact: str, scores: str) -> str:
    confidence, relevance = scores.split()
    shown = f"'total_{metric}'" if metric else "CAST(NULL AS VARCHAR)"
    return f"""SELECT {task} AS task_no, {number} AS finding_no, {title} AS title, {shown} AS metric,
  {dimensions} AS dimensions, '{query_id}' AS query_id, CAST({impact} AS DOUBLE) AS i,
  CAST({confidence} AS DOUBLE) AS c, CAST({relevance} AS DOUBLE) AS b"""


def _overview(task: int) -> list[str]:
    parts = [
        _finding(
            task, str(i), f"'Headline metric: total_{name}'", name, "''", f"overview_metric_total_{name}",
            f"least(1.0, abs(CAST(sum({name}) AS DOUBLE)) / 1000)", "0.8 0.85",
        ) + " FROM lineitem"
        for i, name in enumerate(REPORT_METRICS)
    ]
    parts.append(
        _finding(task, "7", "'Dataset date coverage'", "", "'l_shipdate'", "overview_date_coverage", "0.45", "0.9 0.7")
    )
    name, dimension = REPORT_METRICS[0], REPORT_DIMENSIONS[0]
    top = f"(SELECT CAST(sum({name}) AS DOUBLE) AS v FROM lineitem GROUP BY {dimension})"
    parts.append(
        _finding(
            task, "8", f"'Top segment concentration on total_{name}'", name, f"'{dimension}'",
            f"overview_top_segments_total_{name}_{dimension}", "max(v) / sum(v)", "0.75 0.78",
        ) + f" FROM {top}"
    )
    return parts


def _trends(task: int, name: str, grain: str) -> list[str]:
    source = f" FROM (WITH {period_series(grain, value=name)} SELECT * FROM a)"
    query_id = f"trends_total_{name}_{grain}"
    last = "(abs(arg_max(CAST(v AS DOUBLE), place)) + 1)"
    spikes = "count(*) FILTER (n > 2 AND sd > 0 AND abs(z) >= 2.0)"
    entries = (
        ("0", f"Strongest increase in total_{name}", f"least(1.0, abs(max(d)) / {last})", "0.78 0.82", ""),
        ("1", f"Strongest decrease in total_{name}", f"least(1.0, abs(min(d)) / {last})", "0.78 0.82", ""),
        ("2", f"total_{name} volatility", "least(1.0, stddev_pop(v) / abs(avg(v)))", "0.74 0.7", ""),
        ("3", f"Spike/drop flags for total_{name}", f"{spikes} / count(*)", "0.69 0.76", f" HAVING {spikes} > 0"),
    )
    return [
        _finding(task, number, f"'{title}'", name, "'l_shipdate'", query_id, impact, scores) + source + having
        for number, title, impact, scores, having in entries
    ]


def _anomalies(task: int, name: str, grain: str) -> list[str]:
    flags = "count(*) FILTER (n >= 4 AND (abs(z) >= 2.5 OR abs(ms) >= 3.5))"
    source = f" FROM (WITH {period_series(grain, value=name)} SELECT * FROM a)"
    query_id = f"anomalies_total_{name}_{grain}"
    some, none = f"'Anomaly candidates detected for total_{name}'", f"'No strong anomaly signals for total_{name}'"
    return [
        _finding(task, "0", some, name, "'l_shipdate'", query_id, f"{flags} / count(*)", "0.68 0.81")
        + f"{source} HAVING {flags} > 0",
        _finding(task, "0", none, name, "'l_shipdate'", query_id, "0.2", "0.72 0.55") + f"{source} HAVING {flags} = 0",
    ]


def _segments(task: int, dimension: str) -> list[str]:
    name = REPORT_METRICS[0]
    source = f""" FROM (SELECT sum(v) AS total, sum(v) FILTER (place <= 10) AS top, sum(v * v) AS sq, max(v) AS wv,
    min(v) FILTER (place <= 10) AS lv FROM (SELECT CAST(sum({name}) AS DOUBLE) AS v,
    row_number() OVER (ORDER BY sum({name}) DESC, {dimension}) AS place FROM lineitem GROUP BY {dimension}))"""
    tail = "CASE WHEN total - top > 0 THEN (total - top) / total ELSE 0.1 END"  # the text then names 10, of 100
    entries = (
        ("0", f"Top segment for total_{name}", "least(1.0, wv / (total + 1))", "0.82 0.85"),
        ("1", f"Long-tail share for {dimension}", tail, "0.76 0.74"),
        ("2", f"Concentration index for {dimension}", "least(1.0, 4 * sq / (total * total))", "0.7 0.72"),
        ("3", f"Winner/loser spread on {dimension}", "least(1.0, abs(wv - lv) / (abs(wv) + 1))", "0.72 0.79"),
    )
    query_id = f"segments_total_{name}_{dimension}"
    return [
        _finding(task, number, f"'{title}'", name, f"'{dimension}'", query_id, impact, scores) + source
        for number, title, impact, scores in entries
    ]


def _diagnostics(task: int) -> list[str]:
    ratios = union(
        [
            f"""SELECT {i} AS o, '{name}' AS name, max(x) / min(x) AS ratio FROM (
  SELECT count(DISTINCT {name}) AS x FROM lineitem GROUP BY date_trunc('month', l_shipdate))"""
            for i, name in enumerate(REPORT_DIMENSIONS)
        ]
    )
    unstable = f" FROM ({ratios}) WHERE ratio >= 3.0"
    return [
        _finding(
            task, "2", "'Category explosion risk'", "", "string_agg(name, ',' ORDER BY o)",
            "diagnostics_category_explosion", "least(1.0, max(ratio) / 5)", "0.68 0.73",
        ) + f"{unstable} HAVING count(*) > 0",
        _finding(
            task, "4", "'No critical diagnostics alerts'", "", "''", "diagnostics_summary", "0.2", "0.7 0.55"
        ) + f"{unstable} HAVING count(*) = 0",
    ]


def _report(parts: list[list[str]]) -> str:
    return f"""
WITH f AS ({union([part for task in parts for part in task])}),
s AS (SELECT *, i * CAST(0.45 AS DOUBLE) + c * CAST(0.35 AS DOUBLE) + b * CAST(0.20 AS DOUBLE) AS combined FROM f)
SELECT row_number() OVER (ORDER BY combined DESC, task_no, finding_no) AS "rank", title, metric, dimensions, query_id,
  round(i, 6) AS impact_score, round(combined, 6) AS combined_score,
  CASE WHEN combined >= 0.7 THEN 'high' WHEN combined >= 0.4 THEN 'medium' ELSE 'low' END AS severity FROM s"""


def _each(make, names, first: int, *rest: str) -> list[list[str]]:
    return [make(task, name, *rest) for task, name in enumerate(names, first)]


ORACLE["run_analysis"] = _report(
    [
        _overview(1), *_each(_trends, REPORT_METRICS, 2, "month"), *_each(_segments, REPORT_DIMENSIONS, 9), _diagnostics(12)
    ]
)
ORACLE["saved_evidence"] = ORACLE["run_analysis"]
ORACLE["run_analysis_overview"] = _report([_overview(1), _diagnostics(2)])
ORACLE["run_analysis_diagnostic"] = _report(
    [
        *_each(_trends, REPORT_METRICS, 1, "week"), _diagnostics(8), *_each(_anomalies, REPORT_METRICS, 9, "week")
    ]
)
_both = [
    part for task, name in enumerate(REPORT_METRICS)
    for part in (_trends(2 + 2 * task, name, "month"), _anomalies(3 + 2 * task, name, "week"))
]
ORACLE["run_analysis_deep_dive"] = _report(
    [_overview(1), *_both, *_each(_segments, REPORT_DIMENSIONS, 16), _diagnostics(19)]
)
