"""Column profiles: nulls, distinct values, numeric statistics, roles.

Every table-wide statistic is one aggregation with a one-row result, turned into one row per column afterwards. Distinct
values are counted by their hashes; roles alone need sketches and few exact counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.distinct import SKETCH_MARGIN, column_counts, distinct_estimate
from tallyline.functions.metrics import column
from tallyline.functions.small import small_table
from tallyline.functions.periods import as_timestamp, is_time
from tallyline.functions.quantiles import exact_medians

# Fixed values.
TOP_VALUES = 5
RATE_DIGITS = 6
TIME_WORDS = ("date", "time", "_at")
UNIQUE_RATIO = 0.98
UNIQUE_MIN_ROWS = 20
DIMENSION_MIN_DISTINCT = 50
DIMENSION_RATIO = 0.2

_TEXT_TYPES = (T.StringType, T.CharType, T.VarcharType)
_NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def type_class(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if is_time(data_type):
        return "time"
    if isinstance(data_type, _TEXT_TYPES):
        return "text"
    return "nested" if isinstance(data_type, (*_NESTED_TYPES, T.VariantType)) else "other"


def _per_column(one_row: DataFrame, fields: list[T.StructField], entries: list[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per column."""
    if not entries:
        return small_table(one_row.sparkSession, [], T.StructType(fields))
    return one_row.select(F.inline(F.array(*entries)))


def _text(field: T.StructField) -> Column:
    """A value as text, different for different values."""
    value = column(field.name)
    if isinstance(field.dataType, T.BinaryType):
        return F.base64(value)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        value = F.when(value == 0, F.lit(0).cast(field.dataType)).otherwise(value)
    return value.cast("string")


def value_counts(df: DataFrame) -> DataFrame:
    """``ordinal``, ``column``, ``value`` (text) and ``count`` of all values that aren't null, in one scan.

    Counts are combined in every task and spread by (column, value); nested columns are left out.
    """
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if type_class(f.dataType) != "nested"]
    if not fields:
        return small_table(df.sparkSession, [], "ordinal int, column string, value string, count bigint")
    values = [F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"), _text(f).alias("value")) for i, f in fields]
    return (
        df.select(F.inline(F.array(*values)))
        .filter(F.col("value").isNotNull())
        .groupBy("ordinal", "column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: type, nulls, null rate, distinct count and inferred role, in one scan.

    The distinct count is exact at every size, or from a sketch, without a shuffle of the values, on request; nested
    columns have none. Where only the roles are asked for, ``role_profile`` costs less.
    """
    fields = list(df.schema.fields)
    known = [field.name for field in fields if type_class(field.dataType) != "nested"]
    if approx:
        return _described(df, _sketched(df, known))
    nested = [field.name for field in fields if field.name not in known]
    places = {name: i for i, name in enumerate(df.columns)}
    order = F.array(*[F.lit(places[name]) for name in (*known, *nested)])
    counted = column_counts(df, known, nested).withColumn("ordinal", F.get(order, F.col("ordinal")))
    return _described(df, counted)


def _sketched(df: DataFrame, names: list[str]) -> DataFrame:
    """``row_count``, ``null_count`` and, for the named columns, an estimated ``distinct_count``, by ``ordinal``."""
    aggregates: list[Column] = [F.count(F.lit(1)).alias("row_count")]
    for i, field in enumerate(df.schema.fields):
        aggregates.append(F.count_if(column(field.name).isNull()).alias(f"nulls{i}"))
        if field.name in names:
            aggregates.append(F.coalesce(distinct_estimate(field), F.lit(0)).alias(f"distinct{i}"))
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.col("row_count"),
            F.col(f"nulls{i}").alias("null_count"),
            (F.col(f"distinct{i}") if name in names else F.lit(None).cast("bigint")).alias("distinct_count"),
        )
        for i, name in enumerate(df.columns)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))


def _described(df: DataFrame, counted: DataFrame) -> DataFrame:
    """The counts with each column's name and type, its null rate and its role; without rows all counts are 0."""
    columns = [
        (i, field.name, field.dataType.simpleString(), type_class(field.dataType)) for i, field in enumerate(df.schema.fields)
    ]
    named = small_table(df.sparkSession, columns, "ordinal int, column string, data_type string, type_class string")
    none = F.when(F.col("type_class") == "nested", F.lit(None)).when(F.col("row_count").isNull(), 0)
    profile = named.join(counted, "ordinal", "left").select(
        *named.columns,
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("null_count", F.lit(0)).alias("null_count"),
        F.coalesce("distinct_count", none).cast("bigint").alias("distinct_count"),
    )
    rate = F.when(F.col("row_count") > 0, F.col("null_count") / F.col("row_count")).otherwise(F.lit(0.0))
    return profile.withColumn("null_rate", F.round(rate, RATE_DIGITS)).withColumn("role", role())


def role_profile(df: DataFrame) -> DataFrame:
    """The rows of ``column_profile`` with the same roles, but with distinct counts only where a role hangs on them.

    One scan counts rows and nulls and sketches the columns whose type and name don't decide. A column with enough nulls
    can't be unique; else a sketch settles its role unless a limit lies within ``SKETCH_MARGIN`` of the estimate. Only the
    columns that are still open are counted exactly, in a second scan. Runs at once; the result has one row per column.
    """
    open_ = [field.name for field in df.schema.fields if not _role_is_given(field)]
    rows = {row["ordinal"]: row.asDict() for row in _sketched(df, open_).collect()}
    near: list[str] = []
    for i, field in enumerate(df.schema.fields):
        if field.name in open_:
            low, high = _bounds(rows[i])
            total, present = rows[i]["row_count"], rows[i]["row_count"] - rows[i]["null_count"]
            limits = [UNIQUE_RATIO * total] if total > UNIQUE_MIN_ROWS and present > UNIQUE_RATIO * total else []
            if type_class(field.dataType) == "other":
                limits.append(max(DIMENSION_MIN_DISTINCT, total * DIMENSION_RATIO // 1))
            if any(low <= limit < high for limit in limits):
                near.append(field.name)
    exact = {near[row["ordinal"]]: row["distinct_count"] for row in column_counts(df, near).collect()} if near else {}
    entries = [
        (i, row["row_count"], row["null_count"], exact.get(df.columns[i], row["distinct_count"])) for i, row in sorted(rows.items())
    ]
    counted = small_table(df.sparkSession, entries, "ordinal int, row_count bigint, null_count bigint, distinct_count bigint")
    settled = F.col("column").isin(near) if near else F.lit(False)
    return _described(df, counted).withColumn("distinct_count", F.when(settled, F.col("distinct_count")))


def _role_is_given(field: T.StructField) -> bool:
    """Whether a column's type or name decides its role, or nothing can be counted."""
    name = field.name.lower()
    kind = type_class(field.dataType)
    return kind in ("time", "nested") or any(word in name for word in TIME_WORDS) or name == "id" or name.endswith("_id")


def _bounds(row: dict) -> tuple[float, float]:
    """Between which numbers the distinct count lies: the sketch's margin, and no more than there are values."""
    present = row["row_count"] - row["null_count"]
    estimate = row["distinct_count"]
    return estimate / (1 + SKETCH_MARGIN) - 1, min(present, estimate / (1 - SKETCH_MARGIN) + 1) + 1


def role() -> Column:
    """The role rules, in order, over the columns of ``column_profile``."""
    name = F.lower("column")
    distinct, rows = F.col("distinct_count"), F.col("row_count")
    few = F.greatest(F.lit(DIMENSION_MIN_DISTINCT), F.floor(rows * DIMENSION_RATIO))
    return (
        F.when((F.col("type_class") == "time") | name.rlike("|".join(TIME_WORDS)), "time")
        .when((name == "id") | name.endswith("_id"), "id")
        .when((rows > UNIQUE_MIN_ROWS) & (distinct / rows > UNIQUE_RATIO), "id")
        .when(F.col("type_class") == "numeric", "measure")
        .when(distinct <= few, "dimension")
        .when(F.col("type_class") == "text", "dimension")
        .otherwise("unknown")
    )


NUMERIC_SCHEMA = "ordinal int, column string, min double, max double, mean double, median double, stddev double"


def numeric_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Min, max, mean, median and sample deviation of each numeric column, as doubles.

    The median is exact and searched for in a few passes, unless ``approx`` allows an approximate one.
    """
    values = {
        field.name: column(field.name).cast("double")
        for field in df.schema.fields
        if type_class(field.dataType) == "numeric"
    }
    if not values:
        return small_table(df.sparkSession, [], NUMERIC_SCHEMA)
    if approx:
        medians = {name: F.percentile_approx(value, 0.5) for name, value in values.items()}
    else:
        medians = {name: F.max(F.lit(found).cast("double")) for name, found in exact_medians(df, values).items()}
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(name).alias("column"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.avg(value).alias("mean"),
            medians[name].alias("median"),
            F.stddev_samp(value).alias("stddev"),
        )
        for i, (name, value) in enumerate(values.items())
    ]
    return df.agg(F.array(*entries).alias("statistics")).select(F.inline("statistics"))


def top_values(df: DataFrame) -> DataFrame:
    """The most frequent values, as text, of each column; equal counts are ordered by value.

    The limit on the place is applied in each task before rows are shuffled by column.
    """
    ranked = Window.partitionBy("ordinal", "column").orderBy(F.desc("count"), "value")
    return (
        value_counts(df)
        .withColumn("place", F.row_number().over(ranked))
        .filter(F.col("place") <= TOP_VALUES)
        .select("column", "value", "count", "place")
    )


def date_ranges(df: DataFrame, time_columns: list[str]) -> DataFrame:
    """First and last timestamp of each time column, in schema order."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggregates, entries = [], []
    for i, name in enumerate(time_columns):
        stamp = as_timestamp(name, types[name])
        aggregates += [F.min(stamp).alias(f"min{i}"), F.max(stamp).alias(f"max{i}")]
        entries.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(name).alias("column"),
                F.col(f"min{i}").alias("date_min"),
                F.col(f"max{i}").alias("date_max"),
            )
        )
    fields = [
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("date_min", T.TimestampNTZType()),
        T.StructField("date_max", T.TimestampNTZType()),
    ]
    return _per_column(df.agg(*aggregates) if aggregates else df, fields, entries)


def dataset_date_range(df: DataFrame, time_columns: list[str]) -> DataFrame:
    """The date range of the data set: that of the last time column that has any value."""
    filled = F.when(F.col("date_min").isNotNull(), F.col("ordinal"))
    return date_ranges(df, time_columns).agg(
        F.max_by("date_min", filled).alias("date_min"), F.max_by("date_max", filled).alias("date_max")
    )


def candidates(profile: DataFrame) -> DataFrame:
    """One row with the time, dimension and measure columns, each in schema order."""

    def names(wanted: str) -> Column:
        matching = F.collect_list(F.when(F.col("role") == wanted, F.struct("ordinal", "column")))
        return F.array_sort(matching)["column"]

    return profile.agg(
        names("time").alias("time_columns"),
        names("dimension").alias("dimension_columns"),
        names("measure").alias("measure_columns"),
    )


@dataclass(frozen=True)
class DatasetProfile:
    """The profile of a data set, one table for each part."""

    dataset_name: str
    row_count: int
    columns: DataFrame
    numeric: DataFrame
    top_values: DataFrame
    date_ranges: DataFrame
    date_range: DataFrame
    candidates: DataFrame

    def table(self) -> DataFrame:
        """One row per column with its statistics and top values; small, one row for each column of the data."""
        tops = self.top_values.groupBy("column").agg(
            F.array_sort(F.collect_list(F.struct("place", "value", "count"))).alias("tops")
        )
        return (
            self.columns.join(self.numeric.drop("ordinal"), "column", "left")
            .join(tops, "column", "left")
            .withColumn("top_values", F.transform("tops", lambda top: F.struct(top["value"], top["count"])))
            .join(self.date_ranges.drop("ordinal"), "column", "left")
            .drop("tops")
            .withColumn("dataset_name", F.lit(self.dataset_name))
        )


def profile_dataset(dataset_name: str, df: DataFrame, approx: bool = False) -> DatasetProfile:
    """Profile a whole table. The roles decide which columns have a date range, so they are read first."""
    profile = column_profile(df, approx)
    found = sorted(profile.collect(), key=lambda row: row["ordinal"])
    columns = small_table(df.sparkSession, found, profile.schema)
    time_columns = [row["column"] for row in found if row["role"] == "time"]
    return DatasetProfile(
        dataset_name=dataset_name,
        row_count=found[0]["row_count"],
        columns=columns,
        numeric=numeric_profile(df, approx),
        top_values=top_values(df),
        date_ranges=date_ranges(df, time_columns),
        date_range=dataset_date_range(df, time_columns),
        candidates=candidates(columns),
    )
