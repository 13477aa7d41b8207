"""A metric by segment: ranking, contribution, concentration.

Statistics cover every segment. Top rows without keys are a top-k sort; with keys the row-number limit is applied in
each task before the shuffle. A ranking of all segments goes through ``functions.ordered``, which splits what is large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.metrics import column, metric_column
from tallyline.functions.ordered import MAX_GROUP_ROWS, ordered_rows
from tallyline.functions.text import number_text
from tallyline.operators.series import as_value

# Fixed values.
TOP_SEGMENTS = 10
HIGH_TOP_SHARE = 0.5
LOW_TAIL_SHARE = 0.2
HIGH_CONCENTRATION = 0.25
CONCENTRATION_IMPACT = 4.0


def segment_totals(df: DataFrame, sql: str, dimension: str, by: Sequence[str] = ()) -> DataFrame:
    """The metric of every segment; ``value`` counts a null metric as 0."""
    keys = list(map(column, by))
    totals = df.groupBy(*keys, column(dimension).alias("segment")).agg(
        metric_column(sql, df.columns).alias("metric_value")
    )
    return totals.withColumn("value", as_value("metric_value"))


def many_totals(df: DataFrame, sql: str, dimensions: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The metric of every segment of every dimension, in one scan, and the names of the columns that hold segments.

    ``ordinal`` counts through the dimensions. Each row becomes one a dimension, which partial aggregation folds before
    anything is shuffled. Dimensions of one data type share a segment column, so that segments keep their own order.
    """
    types = {field.name: field.dataType for field in df.schema.fields}
    kinds = list(dict.fromkeys(types[name].simpleString() for name in dimensions))
    prefix = "key"
    while any(name.lower().startswith(prefix) for name in df.columns):
        prefix = f"_{prefix}"
    keys = [f"{prefix}{n}" for n in range(len(kinds))]
    entries = [
        F.struct(
            F.lit(number).alias("ordinal"),
            *[
                (column(name) if types[name].simpleString() == kind else F.lit(None).cast(kind)).alias(key)
                for kind, key in zip(kinds, keys, strict=True)
            ],
        )
        for number, name in enumerate(dimensions)
    ]
    place = f"{prefix}_of"
    rows = df.select("*", F.inline(F.array(*entries)).alias(place, *keys))
    totals = rows.groupBy(F.col(place).alias("ordinal"), *keys).agg(metric_column(sql, df.columns).alias("metric_value"))
    return totals.withColumn("value", as_value("metric_value")), keys


def top_segments(
    totals: DataFrame, limit: int, by: Sequence[str] = (), segment: Sequence[str] = ("segment",)
) -> DataFrame:
    """The first ``limit`` segments by metric, null metrics last, equal ones by segment; ``place`` counts from 1."""
    order = _order(segment)
    place = F.row_number().over(Window.partitionBy(*map(column, by)).orderBy(*order)).cast("bigint")
    if by:
        return totals.withColumn("place", place).filter(F.col("place") <= limit)
    return totals.orderBy(*order).limit(limit).withColumn("place", place)


def _order(segment: Sequence[str] = ("segment",)) -> list[Column]:
    return [F.col("metric_value").desc_nulls_last(), *[F.col(name).asc_nulls_last() for name in segment]]


def segment_ranking(
    df: DataFrame,
    sql: str,
    dimension: str,
    by: Sequence[str] = (),
    max_segments: int | None = None,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """All segments in the order of the metric, or the first ``max_segments``; equal ones by segment."""
    totals = segment_totals(df, sql, dimension, by)
    if max_segments is not None:
        return top_segments(totals, max_segments, by)
    return ordered_rows(totals, list(by), _order(), max_group_rows).number("place").done()


def segment_summary(df: DataFrame, sql: str, dimension: str, by: Sequence[str] = ()) -> DataFrame:
    """Leader, long tail, concentration and spread over every segment: one row per key, one row in all without keys."""
    return _summary(segment_totals(df, sql, dimension, by), by)


def segment_summaries(df: DataFrame, sql: str, dimensions: Sequence[str]) -> DataFrame:
    """The summary of every dimension, by its ``ordinal``, from one scan."""
    totals, keys = many_totals(df, sql, dimensions)
    return _summary(totals, ["ordinal"], keys)


def _summary(totals: DataFrame, by: Sequence[str], segment: Sequence[str] = ("segment",)) -> DataFrame:
    keys = list(map(column, by))
    # Sums over every segment and the few leaders meet in one more aggregation, without a window over them all.
    sums = totals.groupBy(*keys).agg(
        F.sum("value").alias("total"),
        F.sum(F.col("value") * F.col("value")).alias("squares"),
        F.count(F.lit(1)).alias("segments"),
    )
    leaders = _leaders(top_segments(totals, TOP_SEGMENTS, by, segment), by, segment)
    both = sums.unionByName(leaders, allowMissingColumns=True).groupBy(*keys)
    merged = both.agg(
        *[F.max(name).alias(name) for name in ("total", "squares", "segments", "top_total")],
        *[F.max(name).alias(name) for name in ("winner", "winner_value", "winner_text", "loser", "loser_value")],
    )
    total = F.col("total")
    return (
        merged.filter(F.col("segments") > 0)
        .withColumn("long_tail_share", F.when(total != 0, (total - F.col("top_total")) / total).otherwise(0.0))
        .withColumn("concentration", F.when(total > 0, F.col("squares") / (total * total)).otherwise(0.0))
        .withColumn("top_share", F.when(total != 0, F.col("winner_value") / total).otherwise(0.0))
        .withColumn("top_severity", _top_severity())
        .withColumn("spread", F.col("winner_value") - F.col("loser_value"))
        .withColumn("leader_impact", F.least(F.lit(1.0), F.col("winner_value") / (total + 1.0)))
        .withColumn("spread_impact", F.least(F.lit(1.0), F.abs("spread") / (F.abs("winner_value") + 1.0)))
    )


def _top_severity() -> Column:
    return F.when(F.col("top_share") >= HIGH_TOP_SHARE, "high").otherwise("medium")


def _leaders(ranked: DataFrame, by: Sequence[str], segment: Sequence[str]) -> DataFrame:
    """The best and the last of the top segments, with their total."""
    top = F.col("place") <= TOP_SEGMENTS
    place = F.when(top, F.col("place"))
    name = F.coalesce(*[F.col(own).cast("string") for own in segment], F.lit("None"))
    shown = F.coalesce(number_text(ranked, "metric_value"), F.lit("None"))
    return ranked.groupBy(*map(column, by)).agg(
        F.sum(F.when(top, F.col("value"))).alias("top_total"),
        F.min_by(name, place).alias("winner"),
        F.min_by("value", place).alias("winner_value"),
        F.min_by(shown, place).alias("winner_text"),
        F.max_by(name, place).alias("loser"),
        F.max_by("value", place).alias("loser_value"),
    )


def top_concentration(df: DataFrame, sql: str, dimension: str, by: Sequence[str] = ()) -> DataFrame:
    """The share of the first segment, equal ones by segment, in the sum of all."""
    first = F.struct(
        F.col("metric_value").isNull(), -F.col("value"), F.col("segment").isNull(), F.col("segment").cast("string")
    )
    summary = segment_totals(df, sql, dimension, by).groupBy(*map(column, by)).agg(
        F.count(F.lit(1)).alias("segments"),
        F.min_by("value", first).alias("top_value"),
        F.sum("value").alias("total"),
    )
    total = F.col("total")
    return (
        summary.filter(F.col("segments") > 0)
        .withColumn("top_share", F.when(total != 0, F.col("top_value") / total).otherwise(0.0))
        .withColumn("severity", _top_severity())
    )
