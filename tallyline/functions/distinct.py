"""Exact distinct counts of many columns in one scan, and sketches that settle what needs no exact count.

Each row turns into one small row a column: the column's number and a 128-bit hash of its value. These are deduplicated in
every task and spread by (keys, column, hash), and then counted, so neither texts nor whole rows travel, no row is
multiplied before it is reduced, and any number of columns goes in the same two aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.metrics import column

SKETCH_SIZE = 14
# Six standard deviations of a sketch of that size: beyond them lies one estimate of half a billion.
SKETCH_MARGIN = 6 * 1.04 / 2 ** (SKETCH_SIZE / 2)


def comparable(field: T.StructField) -> Column:
    """A column's value with one zero, so that equal values have equal hashes."""
    value = column(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(value == 0, F.lit(0).cast(field.dataType)).otherwise(value)
    return value


def distinct_estimate(field: T.StructField) -> Column:
    """The number of distinct values of a column, within ``SKETCH_MARGIN``, without a shuffle of values."""
    hashed = F.when(column(field.name).isNotNull(), F.xxhash64(comparable(field)))
    return F.hll_sketch_estimate(F.hll_sketch_agg(hashed, SKETCH_SIZE))


def _entry(number: int, field: T.StructField, counted: bool) -> Column:
    present = column(field.name).isNotNull()
    value = comparable(field)
    high = F.xxhash64(value, F.lit(1)) if counted else F.lit(0).cast("long")
    low = F.xxhash64(F.lit(2), value) if counted else F.lit(0).cast("long")
    return F.struct(F.lit(number).alias("ordinal"), F.when(present, high).alias("high"), F.when(present, low).alias("low"))


def column_counts(
    df: DataFrame, distinct: Sequence[str], others: Sequence[str] = (), by: dict[str, Column] | None = None
) -> DataFrame:
    """``row_count``, ``null_count`` and ``distinct_count`` of columns, by ``ordinal``, in one scan; no rows without data.

    ``ordinal`` counts through ``distinct`` and then ``others``, whose distinct count is null. ``by`` names keys.
    """
    fields = {field.name: field for field in df.schema.fields}
    names = [*distinct, *others]
    entries = [_entry(number, fields[name], number < len(distinct)) for number, name in enumerate(names)]
    keys = list(by or {})
    rows = df.select(*[key.alias(name) for name, key in (by or {}).items()], F.inline(F.array(*entries)))
    values = rows.groupBy(*keys, "ordinal", "high", "low").agg(F.count(F.lit(1)).alias("n"))
    counted = F.when(F.col("ordinal") < len(distinct), F.count("high"))
    return values.groupBy(*keys, "ordinal").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("high").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        counted.alias("distinct_count"),
    )
