"""Data-quality checks: missing values, near-unique dimensions, unstable categories, duplicate keys.

All table-wide counts come from one scan. Distinct values are deduplicated in every task, as hashes beside their column's
number, and spread by both (``functions.distinct``), so a frequent value costs one row per task and the number of
dimensions is not limited.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.distinct import column_counts
from tallyline.functions.metrics import column
from tallyline.functions.small import small_table
from tallyline.functions.periods import as_timestamp, period_start

# Fixed values.
WORST_COLUMNS = 3
MISSING_RATE = 0.2
MISSING_HIGH_RATE = 0.4
CARDINALITY_RATIO = 0.8
INSTABILITY_RATIO = 3.0
INSTABILITY_SCALE = 5.0


def key_candidate(names: Sequence[str]) -> str | None:
    """The first column called ``id`` or ending in ``_id``."""
    for name in names:
        if name.lower() == "id" or name.lower().endswith("_id"):
            return name
    return None


def _distinct(name: str, approx: bool) -> Column:
    return F.approx_count_distinct(column(name)) if approx else F.count_distinct(column(name))


def count_row(
    df: DataFrame,
    missing: Sequence[str] = (),
    distinct: Sequence[str] = (),
    key: str | None = None,
    approx: bool = False,
) -> DataFrame:
    """One row with the row count, null counts ``nulls<i>``, distinct counts ``distinct<i>`` and key duplicates.

    Distinct counts of dimensions are exact unless ``approx`` allows a sketch; that of the key is always exact.
    """
    counted = list(dict.fromkeys([*([] if approx else distinct), *([key] if key is not None else [])]))
    if counted and not approx:
        return _exact_row(df, list(missing), list(distinct), key, counted)
    aggregates = [F.count(F.lit(1)).alias("row_count")]
    aggregates += [F.count_if(column(name).isNull()).alias(f"nulls{i}") for i, name in enumerate(missing)]
    aggregates += [_distinct(name, approx).alias(f"distinct{i}") for i, name in enumerate(distinct)]
    if key is not None:
        aggregates.append((F.count(F.lit(1)) - F.count_distinct(column(key))).alias("duplicates"))
    return df.agg(*aggregates)


def _exact_row(df: DataFrame, missing: list[str], distinct: list[str], key: str | None, counted: list[str]) -> DataFrame:
    """The counts of ``count_row``, exactly, from one scan; all are 0 without rows."""
    others = [name for name in dict.fromkeys(missing) if name not in counted]
    places = {name: i for i, name in enumerate([*counted, *others])}

    def of(value: str, name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("ordinal") == places[name], F.col(value))), F.lit(0))

    aggregates = [F.coalesce(F.max("row_count"), F.lit(0)).alias("row_count")]
    aggregates += [of("null_count", name).alias(f"nulls{i}") for i, name in enumerate(missing)]
    aggregates += [of("distinct_count", name).alias(f"distinct{i}") for i, name in enumerate(distinct)]
    if key is not None:
        aggregates.append((of("row_count", key) - of("distinct_count", key)).alias("duplicates"))
    return column_counts(df, counted, others).agg(*aggregates)


def _share(part: str):
    return F.when(F.col("row_count") > 0, F.col(part) / F.col("row_count")).otherwise(F.lit(0.0))


def missing_table(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    entries = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("column"), F.col(f"nulls{i}").alias("null_count"))
        for i, name in enumerate(names)
    ]
    rows = counts.select("row_count", F.inline(F.array(*entries)))
    return rows.withColumn("null_rate", _share("null_count"))


def missingness(df: DataFrame) -> DataFrame:
    """Null count and rate of every column."""
    return missing_table(count_row(df, missing=df.columns), df.columns)


def worst_missing(missing: DataFrame) -> DataFrame:
    """The columns with the highest null rate; equal rates keep the schema order."""
    return missing.orderBy(F.desc("null_rate"), "ordinal").limit(WORST_COLUMNS)


def cardinality_table(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(name).alias("dimension"), F.col(f"distinct{i}").alias("distinct_count")
        )
        for i, name in enumerate(names)
    ]
    rows = counts.select("row_count", F.inline(F.array(*entries)))
    return rows.withColumn("cardinality_ratio", _share("distinct_count")).withColumn(
        "near_unique", F.col("cardinality_ratio") > CARDINALITY_RATIO
    )


def cardinality(df: DataFrame, dimensions: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct values of each dimension relative to the rows."""
    names = list(dimensions)
    return cardinality_table(count_row(df, distinct=names, approx=approx), names)


def instability(df: DataFrame, time_column: str, dimensions: Sequence[str], approx: bool = False) -> DataFrame:
    """How much the number of distinct values of each dimension varies from month to month.

    The ratio is that of the largest to the smallest month, or the largest itself when the smallest has none. All
    dimensions share one scan, over all months.
    """
    names = list(dimensions)
    month = period_start(as_timestamp(time_column, df.schema[time_column].dataType), "month")
    if not names:
        return small_table(df.sparkSession, [],
            "ordinal int, dimension string, max_count bigint, min_count bigint, "
            "explosion_ratio double, unstable boolean",
        )
    if approx:
        months = df.groupBy(month.alias("period")).agg(
            *[_distinct(name, approx).alias(f"distinct{i}") for i, name in enumerate(names)]
        )
        entries = [
            F.struct(F.lit(i).alias("ordinal"), F.col(f"distinct{i}").alias("distinct_count")) for i in range(len(names))
        ]
        by_month = months.select(F.inline(F.array(*entries)))
    else:
        by_month = column_counts(df, names, by={"period": month})
    ranges = (
        by_month.withColumn("dimension", F.get(F.lit(names), F.col("ordinal")))
        .groupBy("ordinal", "dimension")
        .agg(F.max("distinct_count").alias("max_count"), F.min("distinct_count").alias("min_count"))
    )
    ratio = F.when(F.col("min_count") > 0, F.col("max_count") / F.col("min_count")).otherwise(
        F.col("max_count").cast("double")
    )
    return ranges.withColumn("explosion_ratio", ratio).withColumn(
        "unstable", F.col("explosion_ratio") >= INSTABILITY_RATIO
    )


def duplicate_keys(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows beyond the distinct keys of the key candidate; null keys count as duplicates."""
    name = key or key_candidate(df.columns)
    if name is None:
        fields = [T.StructField("key", T.StringType()), T.StructField("duplicate_count", T.LongType())]
        schema = T.StructType([*fields, T.StructField("row_count", T.LongType())])
        return small_table(df.sparkSession, [], schema)
    return count_row(df, key=name).select(
        F.lit(name).alias("key"), F.col("duplicates").alias("duplicate_count"), "row_count"
    )
