"""Time columns and calendar periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.metrics import column

# The calendar grains.
TREND_GRAINS = ("day", "week", "month", "quarter", "year")
ANOMALY_GRAINS = ("day", "week", "month")

_TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_time(data_type: T.DataType) -> bool:
    return isinstance(data_type, _TIME_TYPES)


def as_timestamp(name: str, data_type: T.DataType) -> Column:
    """The column as a wall-clock timestamp; text that is no timestamp, and other types, give null."""
    if is_time(data_type):
        return column(name).cast("timestamp_ntz")
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return column(name).try_cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def period_start(timestamp: Column, grain: str, allowed: tuple[str, ...] = TREND_GRAINS) -> Column:
    """The first instant of the day, Monday week, month, quarter or year.

    Every grain is a whole number of days, so the cut is made on dates and does not depend on the session zone.
    """
    if grain not in allowed:
        raise ValueError(f"Unsupported grain: {grain}")
    day = timestamp.cast("date")
    return (day if grain == "day" else F.trunc(day, grain)).cast("timestamp_ntz")
