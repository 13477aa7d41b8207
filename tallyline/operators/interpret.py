"""Reading a query result: the leading row and the axes of a chart."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.metrics import column
from tallyline.functions.small import small_table
from tallyline.functions.text import fill, number_text
from tallyline.operators.profile import type_class

# Fixed values.
METRIC_WORDS = ("revenue", "sales", "amount", "count", "total", "sum", "avg", "mean", "units")
TIME_WORDS = ("date", "time")
LEAD = "Answer to '{question}': returned {rows} rows in {ms} ms."
NO_ROWS = "No rows returned for question: {question}"
NON_NUMERIC = "{lead} Results are non-numeric, so no ranking insight was computed."
INSIGHT = "{lead} Top insight: {label} leads on {metric} with {value}. {caveat}"
TOP_ROW = "top row"
MAY_BE_CUT = "Preview may be truncated."
COMPLETE = "Result preview represents full returned rows."


def metric_order(columns: Sequence[str], metric_names: Sequence[str] = ()) -> list[str]:
    """Columns in the order they are tried as the metric: known or metric-like ones first."""
    lowered = {name.lower() for name in columns}
    preferred = [name for name in metric_names if name.lower() in lowered]
    if not preferred:
        preferred = [name for name in columns if any(word in name.lower() for word in METRIC_WORDS)]
    return list(dict.fromkeys([*[name for name in preferred if name in columns], *columns]))


def label_order(
    columns: Sequence[str], metric_names: Sequence[str] = (), dimension_names: Sequence[str] = ()
) -> list[str]:
    """Columns in the order they are tried as the label of the leading row."""
    lowered = {name.lower() for name in columns}
    preferred = [name for name in dimension_names if name.lower() in lowered]
    if not preferred:
        known = [name for name in metric_names if name.lower() in lowered]
        metrics = known or [name for name in columns if any(word in name.lower() for word in METRIC_WORDS)]
        preferred = [name for name in columns if name not in metrics]
    return list(dict.fromkeys([*[name for name in preferred if name in columns], *columns]))


def top_insight(
    result: DataFrame,
    question: str,
    metric_names: Sequence[str] = (),
    dimension_names: Sequence[str] = (),
    preview_rows: int | None = None,
    row_count: int | None = None,
    duration_ms: int = 0,
    truncated: bool = False,
) -> DataFrame:
    """One row: the first metric with values, its largest value, the label of that row and the sentence.

    All rows are looked at, in one aggregation, or only the first ``preview_rows`` on request. The first of equal rows
    leads.
    """
    if row_count is None and preview_rows is not None:
        row_count = result.count()
    total = F.count(F.lit(1)) if row_count is None else F.max(F.lit(row_count))
    preview = result if preview_rows is None else result.limit(preview_rows)
    types = {field.name: type_class(field.dataType) for field in result.schema.fields}
    metrics = [name for name in metric_order(result.columns, metric_names) if types[name] == "numeric"]
    labels = label_order(result.columns, metric_names, dimension_names)

    aggregates: list[Column] = []
    for i, name in enumerate(metrics):
        parts = [
            F.concat(F.lit(f"{other}="), number_text(result, other))
            for other in labels
            if other != name and types[other] != "nested"
        ]
        leading = F.struct(
            F.lit(name).alias("metric"),
            column(name).cast("double").alias("value"),
            number_text(result, name).alias("value_text"),
            F.coalesce(*parts, F.lit(TOP_ROW)).alias("label"),
        )
        rank = F.when(
            column(name).isNotNull(), F.struct(column(name).cast("double").alias("v"), (-F.col("_row")).alias("r"))
        )
        aggregates.append(F.max_by(leading, rank).alias(f"best{i}"))
    numbered = preview.withColumn("_row", F.monotonically_increasing_id())
    if aggregates:
        best = F.coalesce(*[F.col(f"best{i}") for i in range(len(metrics))])
        row = numbered.agg(total.alias("total"), *aggregates).select("total", best.alias("best")).select("total", "best.*")
    else:
        none = F.lit(None).cast("string")
        row = preview.agg(total.alias("total")).withColumns({"metric": none, "value_text": none, "label": none})
        row = row.withColumn("value", F.lit(None).cast("double"))
    # Without rows the largest of a given count is null.
    rows = F.coalesce("total", F.lit(row_count))
    lead = fill(LEAD, question=F.lit(question), rows=rows.cast("string"), ms=F.lit(str(duration_ms)))
    insight = fill(
        INSIGHT,
        lead=lead,
        label=F.col("label"),
        metric=F.col("metric"),
        value=F.col("value_text"),
        caveat=F.lit(MAY_BE_CUT if truncated else COMPLETE),
    )
    text = (
        F.when(rows == 0, F.lit(NO_ROWS.format(question=question)))
        .when(F.col("metric").isNull(), fill(NON_NUMERIC, lead=lead))
        .otherwise(insight)
    )
    return row.select(
        rows.cast("bigint").alias("row_count"),
        F.col("metric").alias("top_metric"),
        F.col("value").alias("metric_value"),
        F.col("label").alias("dimension_label"),
        text.alias("insight"),
    )


def chart_hint(columns: Sequence[str], has_rows: bool) -> str | None:
    """``line``, ``bar``, ``table`` or None."""
    if not has_rows:
        return None
    if len(columns) >= 2 and _time_column(columns):
        return "line"
    if len(columns) == 2:
        return "bar"
    return "table" if len(columns) > 2 else None


def _time_column(columns: Sequence[str]) -> str | None:
    pattern = re.compile("|".join(TIME_WORDS), re.IGNORECASE)
    return next((name for name in columns if pattern.search(name)), None)


def chart_axes(result: DataFrame, hint: str | None) -> tuple[str, str] | None:
    """The label and the value column, or None without a numeric column."""
    label = (_time_column(result.columns) if hint == "line" else None) or result.columns[0]
    numeric = [f.name for f in result.schema.fields if type_class(f.dataType) == "numeric"]
    if not numeric:
        return None
    return label, next((name for name in numeric if name != label), numeric[0])


def chart_series(result: DataFrame, has_rows: bool = True) -> DataFrame:
    """The points of the chart: ``hint, label, value``; no rows when there is nothing to draw."""
    hint = chart_hint(result.columns, has_rows)
    axes = None if hint is None else chart_axes(result, hint)
    if axes is None:
        return small_table(result.sparkSession, [], "hint string, label string, value double")
    label, value = axes
    return result.select(
        F.lit(hint).alias("hint"),
        number_text(result, label).alias("label"),
        column(value).cast("double").alias("value"),
    )
