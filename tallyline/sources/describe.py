"""Looking at a table: its columns with samples, and its first rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.metrics import column
from tallyline.functions.small import small_table
from tallyline.operators.profile import type_class

# Fixed values.
SAMPLES = 3
PREVIEW_ROWS = 20

DESCRIPTION_SCHEMA = "ordinal int, column string, data_type string, nullable boolean, samples array<string>"


def describe_table(df: DataFrame) -> DataFrame:
    """One row per column: type, nullability and its smallest distinct values as text.

    Each sample is the minimum above the one before, so a pass over the table returns one row and shuffles nothing,
    whatever the number of distinct values.
    """
    fields = df.schema.fields
    texts = {i: column(f.name).cast("string") for i, f in enumerate(fields) if type_class(f.dataType) != "nested"}
    samples: dict[int, list[str]] = {i: [] for i in range(len(fields))}
    open_columns = list(texts)
    for _ in range(SAMPLES):
        if not open_columns:
            break
        smallest = []
        for i in open_columns:
            later = texts[i] > F.lit(samples[i][-1]) if samples[i] else texts[i].isNotNull()
            smallest.append(F.min(F.when(later, texts[i])).alias(f"c{i}"))
        row = df.agg(*smallest).first()
        open_columns = [i for i in open_columns if row[f"c{i}"] is not None]
        for i in open_columns:
            samples[i].append(row[f"c{i}"])
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable, samples[i]) for i, f in enumerate(fields)]
    return small_table(df.sparkSession, rows, DESCRIPTION_SCHEMA)


@dataclass(frozen=True)
class Preview:
    columns: list[str]
    rows: DataFrame
    row_count: int
    truncated: bool


def iso_text(name: str, data_type: T.DataType) -> Column:
    """Dates and timestamps as ISO text, other values unchanged."""
    value = column(name)
    if isinstance(data_type, T.DateType):
        return F.date_format(value, "yyyy-MM-dd").alias(name)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        fraction = F.date_format(value, ".SSSSSS")
        seconds = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        return F.concat(seconds, F.when(fraction == ".000000", "").otherwise(fraction)).alias(name)
    return value


def preview_rows(df: DataFrame, limit: int = PREVIEW_ROWS, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows, in the given order if there is one, with dates as ISO text."""
    first = df.orderBy(*map(column, order_by)) if order_by else df
    return first.limit(limit).select(*[iso_text(f.name, f.dataType) for f in df.schema.fields])


def preview(df: DataFrame, limit: int = PREVIEW_ROWS, order_by: Sequence[str] = ()) -> Preview:
    total = df.count()
    return Preview(df.columns, preview_rows(df, limit, order_by), total, total > limit)
