"""Headline metrics and date coverage, in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.metrics import column, metric_column
from tallyline.functions.small import small_table
from tallyline.functions.periods import as_timestamp
from tallyline.functions.text import number_text
from tallyline.models import SemanticModel

# Fixed values.
HEADLINE_SCALE = 1000.0


def headline_row(df: DataFrame, model: SemanticModel) -> DataFrame:
    """One row with the metrics in ``m0, m1, ...`` and the date coverage in ``min_date, max_date``."""
    aggregates = [
        metric_column(metric.sql, df.columns).alias(f"m{i}")
        for i, metric in enumerate(model.metrics)
    ]
    if model.preferred_time_dimension:
        name = model.preferred_time_dimension
        stamp = as_timestamp(name, df.schema[name].dataType)
        aggregates += [F.min(stamp).alias("min_date"), F.max(stamp).alias("max_date")]
    return df.agg(*aggregates, F.count(F.lit(1)).alias("row_count"))


def headlines(row: DataFrame, model: SemanticModel) -> DataFrame:
    """One row per headline metric: its value as a double and as text, and its impact."""
    entries = []
    for i, metric in enumerate(model.metrics):
        raw = column(f"m{i}")
        entries.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(metric.name).alias("metric"),
                raw.cast("double").alias("value"),
                number_text(row, f"m{i}").alias("value_text"),
            )
        )
    if not entries:
        schema = "ordinal int, metric string, value double, value_text string, impact double"
        return small_table(row.sparkSession, [], schema)
    impact = F.least(F.lit(1.0), F.abs(F.coalesce("value", F.lit(0.0))) / HEADLINE_SCALE)
    return row.select(F.inline(F.array(*entries))).withColumn("impact", impact)


def overview_headline(df: DataFrame, model: SemanticModel) -> DataFrame:
    return headlines(headline_row(df, model), model)


def date_coverage(df: DataFrame, time_column: str) -> DataFrame:
    stamp = as_timestamp(time_column, df.schema[time_column].dataType)
    return df.agg(F.min(stamp).alias("min_date"), F.max(stamp).alias("max_date"))
