"""A metric by calendar period: movements, volatility, spikes and anomalies.

The data is aggregated to periods first. Everything after works on one row for each period and ``by`` key; a calendar
has few periods however many rows there are, so windows are small, and with ``by`` columns they also run distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.metrics import column, metric_column, metric_parts
from tallyline.functions.periods import ANOMALY_GRAINS, TREND_GRAINS, as_timestamp, period_start

# Fixed values.
SPIKE_Z = 2.0
ANOMALY_Z = 2.5
ANOMALY_MAD = 3.5
ANOMALY_MIN_PERIODS = 4
MAD_SCALE = 0.6745
PERSISTENT_ANOMALIES = 2


def metric_series(
    df: DataFrame,
    metrics: dict[str, str],
    time_column: str,
    grain: str,
    by: Sequence[str] = (),
    grains: tuple[str, ...] = TREND_GRAINS,
) -> DataFrame:
    """One row per period, the null period included, with one column per metric.

    ``metrics`` maps result columns to metric texts; all of them share one scan. Periods without rows are absent.
    """
    stamp = as_timestamp(time_column, df.schema[time_column].dataType)
    keys = list(map(column, by))
    return df.groupBy(*keys, period_start(stamp, grain, grains).alias("period")).agg(
        *[metric_column(sql, df.columns).alias(name) for name, sql in metrics.items()]
    )


@dataclass(frozen=True)
class DailyStates:
    """What every metric needs of each day, from which all calendar grains follow without the rows.

    ``days`` has one row per ``by`` keys and day, the null day included. Every grain is a whole number of days, so sums,
    counts, minima and maxima of its days are those of its rows; an average is kept as a sum and a count.
    """

    days: DataFrame
    by: tuple[str, ...]
    merges: dict[str, Column]
    values: dict[str, Column]

    def roll_up(self, grain: str, grains: tuple[str, ...] = TREND_GRAINS) -> DataFrame:
        """The rows of ``metric_series`` at one grain. Plans of several grains share the shuffle of the days."""
        period = period_start(F.col("_day").cast("timestamp_ntz"), grain, grains).alias("period")
        keys = list(map(column, self.by))
        merged = self.days.groupBy(*keys, period).agg(*[value.alias(name) for name, value in self.merges.items()])
        return merged.select(*keys, "period", *[value.alias(name) for name, value in self.values.items()])


def daily_states(df: DataFrame, metrics: dict[str, str], time_column: str, by: Sequence[str] = ()) -> DailyStates:
    """Aggregate the rows to days once, for any number of metrics and grains.

    Metrics that need the same sum or count share it.
    """
    types = {field.name: field.dataType for field in df.schema.fields}
    stamp = as_timestamp(time_column, types[time_column])
    partial: dict[str, Column] = {}
    merges: dict[str, Column] = {}
    values: dict[str, Column] = {}
    known: dict[tuple[str, str], str] = {}

    def state(kind: str, name: str, value: Column, merge=F.sum) -> Column:
        place = known.setdefault((kind, name), f"_state{len(known)}")
        partial[place] = value
        merges[place] = merge(F.col(place))
        return F.col(place)

    for result, sql in metrics.items():
        whole = metric_column(sql, df.columns)
        function, name = metric_parts(sql)
        if function == "avg":
            exact = isinstance(types[name], T.DecimalType)
            total = state("total", name, F.sum(column(name) if exact else column(name).cast("double")))
            count = state("count", name, F.count(column(name)))
            mean = total / (count.cast("decimal(20,0)") if exact else count)
            if exact:
                digits, scale = types[name].precision + 4, types[name].scale + 4
                mean = mean.cast(T.DecimalType(min(digits, 38), min(scale, 38)))
            values[result] = F.when(count > 0, mean)
        else:
            merge = {"min": F.min, "max": F.max}.get(function, F.sum)
            values[result] = state(function, name, whole, merge)
    day = stamp.cast("date").alias("_day")
    keys = list(map(column, by))
    days = df.groupBy(*keys, day).agg(*[value.alias(name) for name, value in partial.items()])
    return DailyStates(days, tuple(by), merges, values)


def period_values(
    df: DataFrame,
    sql: str,
    time_column: str,
    grain: str,
    by: Sequence[str] = (),
    grains: tuple[str, ...] = TREND_GRAINS,
) -> DataFrame:
    """The series of one metric as ``(by..., period, value)``; a null value counts as 0."""
    series = metric_series(df, {"value": sql}, time_column, grain, by, grains)
    return series.withColumn("value", as_value("value"))


def long_series(series: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Turn one column per metric into ``(metric, period, value)``, to be analysed with ``by=["metric"]``."""
    entries = [F.struct(F.lit(name).alias("metric"), as_value(name).alias("value")) for name in metrics]
    return series.select("period", F.inline(F.array(*entries)))


def as_value(name: str) -> Column:
    return F.coalesce(column(name).cast("double"), F.lit(0.0))


def _group(by: Sequence[str]):
    return Window.partitionBy(*map(column, by))


def _ordered(by: Sequence[str]):
    return _group(by).orderBy(F.col("period").asc_nulls_last())


def _with_movement(series: DataFrame, by: Sequence[str]) -> DataFrame:
    previous = F.lag("value").over(_ordered(by))
    delta = F.col("value") - F.col("previous")
    return (
        series.withColumn("place", F.row_number().over(_ordered(by)))
        .withColumn("previous", previous)
        .withColumn("delta", delta)
        .withColumn("relative_delta", F.when(F.col("previous") != 0, delta / F.col("previous")))
    )


def trend_deltas(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Absolute and relative change to the previous period that is present; the first period has no row."""
    return (
        _with_movement(series, by)
        .filter(F.col("place") > 1)
        .select(*map(column, by), "period", "delta", "relative_delta")
    )


def trend_spikes(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Periods two or more population deviations from the mean, in series of more than two periods."""
    return (
        _with_z(series, by)
        .filter((F.col("n") > 2) & (F.col("deviation") > 0) & (F.abs("z_score") >= SPIKE_Z))
        .select(*map(column, by), "period", "value", "z_score")
    )


def _with_z(series: DataFrame, by: Sequence[str]) -> DataFrame:
    group = _group(by)
    return (
        series.withColumn("n", F.count(F.lit(1)).over(group))
        .withColumn("mean", F.avg("value").over(group))
        .withColumn("deviation", F.stddev_pop("value").over(group))
        .withColumn("z_score", _ratio(F.col("value") - F.col("mean"), F.col("deviation")))
    )


def _ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 when the whole is 0."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def trend_summary(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Strongest moves, volatility and spike count: one row per key, one row in all without keys.

    Equal moves are decided for the earlier period.
    """
    later = -F.col("place")
    rise = F.struct(F.col("delta"), later.alias("tie"))
    fall = F.struct(F.col("delta"), F.col("place").alias("tie"))
    moved = F.col("delta").isNotNull()
    spike = (F.col("n") > 2) & (F.col("deviation") > 0) & (F.abs("z_score") >= SPIKE_Z)
    summary = (
        _with_z(_with_movement(series, by), by)
        .groupBy(*map(column, by))
        .agg(
            F.count(F.lit(1)).alias("periods"),
            F.max_by("value", "place").alias("last_value"),
            F.max_by("delta", F.when(moved, rise)).alias("max_increase"),
            F.max_by("period", F.when(moved, rise)).alias("max_increase_period"),
            F.min_by("delta", F.when(moved, fall)).alias("max_decrease"),
            F.min_by("period", F.when(moved, fall)).alias("max_decrease_period"),
            F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"),
            F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("deviation"),
            F.count_if(spike).alias("spikes"),
        )
    )
    scale = F.abs("last_value") + 1.0
    volatility = _ratio(F.col("deviation"), F.abs("mean"))
    return (
        summary.withColumn("increase_impact", F.least(F.lit(1.0), F.abs("max_increase") / scale))
        .withColumn("decrease_impact", F.least(F.lit(1.0), F.abs("max_decrease") / scale))
        .withColumn("volatility_ratio", volatility)
    )


def anomaly_scores(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """z-score and median-deviation score of every period, with the change to the previous period."""
    group = _group(by)
    scored = (
        _with_z(_with_movement(series, by), by)
        .withColumn("median", F.median("value").over(group))
        .withColumn("distance", F.abs(F.col("value") - F.col("median")))
        .withColumn("mad", F.median("distance").over(group))
    )
    mad_score = _ratio(MAD_SCALE * (F.col("value") - F.col("median")), F.col("mad"))
    return scored.withColumn("mad_score", mad_score).select(
        *map(column, by),
        "period",
        "value",
        "z_score",
        "mad_score",
        F.col("delta").alias("absolute_delta"),
        "relative_delta",
        F.col("n").alias("periods"),
    )


def is_anomaly() -> Column:
    """The flag rule over the columns of ``anomaly_scores``."""
    strong = (F.abs("z_score") >= ANOMALY_Z) | (F.abs("mad_score") >= ANOMALY_MAD)
    return (F.col("periods") >= ANOMALY_MIN_PERIODS) & strong


def anomaly_flags(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return anomaly_scores(series, by).filter(is_anomaly()).drop("periods")


def anomaly_summary(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many periods are flagged and whether that is persistent, one-off or nothing: one row per key."""
    counted = (
        anomaly_scores(series, by)
        .groupBy(*map(column, by))
        .agg(F.count(F.lit(1)).alias("periods"), F.count_if(is_anomaly()).alias("anomalies"))
    )
    anomalies = F.col("anomalies")
    return (
        counted.withColumn(
            "pattern",
            F.when(anomalies >= PERSISTENT_ANOMALIES, "persistent").when(anomalies == 1, "one-off").otherwise("none"),
        )
        .withColumn(
            "severity",
            F.when(anomalies >= PERSISTENT_ANOMALIES, "high").when(anomalies == 1, "medium").otherwise("low"),
        )
        .withColumn("share", F.least(F.lit(1.0), anomalies / F.greatest(F.col("periods"), F.lit(1))))
    )


__all__ = ["ANOMALY_GRAINS", "TREND_GRAINS"] + [
    "anomaly_flags",
    "anomaly_scores",
    "anomaly_summary",
    "daily_states",
    "long_series",
    "metric_series",
    "period_values",
    "trend_deltas",
    "trend_spikes",
    "trend_summary",
]
