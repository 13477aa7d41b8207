"""The five analyses of a report.

Every function returns the facts it found and its raw outputs; the latter are made only when asked for. All series
share one scan, whatever their metric and grain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tallyline.functions.periods import ANOMALY_GRAINS, TREND_GRAINS
from tallyline.functions.small import small_table
from tallyline.functions.text import fixed_sql, number_text, percent_sql
from tallyline.models import AnalysisTask, SemanticModel
from tallyline.operators import diagnostics as checks
from tallyline.operators import overview, segments, series
from tallyline.operators.finding_texts import (
    ANOMALY_PATTERNS,
    DATE_COVERAGE_IMPACT,
    LISTED_DIMENSIONS,
    NULL_METRIC_CAVEAT,
    QUIET_IMPACT,
)
from tallyline.operators.findings import Fact, collect_facts, unless_others

NumberedTask = tuple[int, AnalysisTask]
RawOutputs = dict[str, Callable[[], DataFrame]]
Output = tuple[DataFrame, RawOutputs]

NO_ALERTS = "no_alerts"
HIGH_VOLATILITY = 0.5


def _named(rows: DataFrame, metric: str | None, dimensions: list[str]) -> DataFrame:
    """Add the metric and the dimensions the facts of these rows are about."""
    return rows.withColumns(
        {
            "metric": F.lit(metric).cast("string"),
            "dimensions": F.lit(dimensions) if dimensions else F.array().cast("array<string>"),
        }
    )


def overview_module(df: DataFrame, model: SemanticModel, task_no: int) -> Output:
    """Headlines and coverage. The share of the top segment comes with the segments, see ``segments_module``."""
    number = F.lit(task_no)
    row = overview.headline_row(df, model)
    raw: RawOutputs = {"headline_metrics": lambda: overview.headlines(row, model)}
    # Headlines and date coverage come from the same row, so they share a scan.
    names = [metric.name for metric in model.metrics]
    shown = _named(row, None, []).withColumns(
        {
            **({"metric_names": F.lit(names)} if names else {}),
            **{f"t{i}": number_text(row, f"m{i}") for i in range(len(names))},
            "time_column": F.lit(model.preferred_time_dimension).cast("string"),
        }
    )
    listed = [
        Fact(
            "headline",
            impact=f"abs(coalesce(double(m{i}), 0.0D)) / {overview.HEADLINE_SCALE}D",
            severity="'medium'",
            number=str(i),
            metric=f"metric_names[{i}]",
            caveats=f"if(m{i} is null, array('{NULL_METRIC_CAVEAT}'), array())",
            values={"value": f"t{i}"},
        )
        for i in range(len(names))
    ]
    if model.preferred_time_dimension:
        raw["date_coverage"] = lambda: row.select("min_date", "max_date")
        listed.append(
            Fact(
                "date_coverage",
                impact=str(DATE_COVERAGE_IMPACT),
                severity="'low'",
                dimensions="array(time_column)",
                number=str(len(names)),
                values={"min_date": "min_date", "max_date": "max_date"},
            )
        )
    facts = collect_facts(shown, number, listed)
    if model.metrics and model.dimensions:
        metric, dimension = model.metrics[0], model.dimensions[0]
        raw["segment_contribution"] = lambda: segments.segment_ranking(
            df, metric.sql, dimension.column, max_segments=segments.TOP_SEGMENTS
        )
    return facts, raw


def task_states(df: DataFrame, model: SemanticModel, tasks: list[AnalysisTask]) -> series.DailyStates:
    """The daily states of all metrics with a trend or anomaly task, which all their grains share."""
    names = dict.fromkeys(task.metric for task in tasks if task.module in ("trends", "anomalies"))
    return series.daily_states(df, {name: model.metric(name).sql for name in names}, model.time_column())


def _task_series(states: series.DailyStates, tasks: list[NumberedTask], grains: tuple[str, ...]) -> DataFrame:
    # All metrics are rolled up, also those without a task at this grain, so that the plans of all grains share the days.
    wide = states.roll_up(tasks[0][1].grain, grains)
    names = list(dict.fromkeys(task.metric for _, task in tasks))
    return series.long_series(wide, list(states.values)).filter(F.col("metric").isin(names))


def _per_task(model: SemanticModel, tasks: list[NumberedTask], summary: DataFrame) -> DataFrame:
    """The summary of each task's metric, one row per task, so that a metric without data keeps its findings."""
    rows = [(task.metric, task_no, task.grain, [model.time_column()]) for task_no, task in tasks]
    known = small_table(summary.sparkSession, rows, "metric string, task_no int, grain string, dimensions array<string>")
    return known.join(summary, "metric", "left")


def trends_module(states: series.DailyStates, model: SemanticModel, tasks: list[NumberedTask]) -> Output:
    """Trends of several metrics at one grain."""
    long = _task_series(states, tasks, TREND_GRAINS)
    rows = _per_task(model, tasks, series.trend_summary(long, by=["metric"]))
    ratio = "coalesce(volatility_ratio, 0.0D)"
    facts = [
        Fact(
            "increase",
            when="max_increase is not null",
            impact="increase_impact",
            severity="'medium'",
            number="0",
            values={"grain": "grain", "delta": fixed_sql("max_increase", 2), "period": "max_increase_period"},
        ),
        Fact(
            "decrease",
            when="max_decrease is not null",
            impact="decrease_impact",
            severity="if(max_decrease < 0, 'high', 'low')",
            number="1",
            values={"grain": "grain", "delta": fixed_sql("max_decrease", 2), "period": "max_decrease_period"},
        ),
        Fact(
            "volatility",
            impact=ratio,
            severity=f"if({ratio} > {HIGH_VOLATILITY}, 'high', 'medium')",
            number="2",
            values={"grain": "grain", "ratio": fixed_sql(ratio, 2)},
        ),
        Fact(
            "spikes",
            when="spikes > 0",
            impact="spikes / greatest(periods, 1)",
            severity="'medium'",
            number="3",
            values={"grain": "grain", "count": "spikes"},
        ),
    ]
    raw = {
        "series": lambda: long,
        "deltas": lambda: series.trend_deltas(long, ["metric"]),
        "volatility_ratio": lambda: series.trend_summary(long, ["metric"]).select("metric", "volatility_ratio"),
        "spike_flags": lambda: series.trend_spikes(long, ["metric"]),
    }
    return collect_facts(rows, F.col("task_no"), facts), raw


def anomalies_module(states: series.DailyStates, model: SemanticModel, tasks: list[NumberedTask]) -> Output:
    """Anomalies of several metrics at one grain."""
    long = _task_series(states, tasks, ANOMALY_GRAINS)
    rows = _per_task(model, tasks, series.anomaly_summary(long, by=["metric"]))
    persistent, once = ANOMALY_PATTERNS["persistent"], ANOMALY_PATTERNS["one-off"]
    facts = [
        Fact(
            "anomalies",
            when="anomalies > 0",
            impact="share",
            severity="severity",
            values={
                "grain": "grain",
                "count": "anomalies",
                "pattern": f"if(anomalies >= {series.PERSISTENT_ANOMALIES}, '{persistent}', '{once}')",
            },
        ),
        Fact(
            "no_anomalies",
            when="coalesce(anomalies, 0) = 0",
            impact=str(QUIET_IMPACT),
            severity="'low'",
            values={"grain": "grain"},
        ),
    ]
    raw = {"series": lambda: long, "anomalies": lambda: series.anomaly_flags(long, ["metric"])}
    return collect_facts(rows, F.col("task_no"), facts), raw


def segments_module(df: DataFrame, model: SemanticModel, tasks: list[NumberedTask], overview_no: int | None = None) -> Output:
    """The segments of all dimensions by one metric, in one scan however many there are.

    With ``overview_no`` the overview's share of the top segment of the first dimension is taken from the same rows.
    """
    names = [task.dimension for _, task in tasks]
    metric = (model.metric(tasks[0][1].metric) if tasks else None) or model.metrics[0]
    if overview_no is not None:
        names.append(model.dimensions[0].name)
    listed = list(dict.fromkeys(names))
    found = segments.segment_summaries(df, metric.sql, [model.dimension(name).column for name in listed])
    numbers = [(task_no, False) for task_no, _ in tasks] + ([(overview_no, True)] if overview_no is not None else [])
    known = small_table(
        df.sparkSession,
        [
            (listed.index(name), task_no, share, metric.name, [name], model.dimension(name).column)
            for name, (task_no, share) in zip(names, numbers, strict=True)
        ],
        "ordinal int, task_no int, share boolean, metric string, dimensions array<string>, column string",
    )
    rows = known.join(found, "ordinal")
    common = {"dimension": "dimensions[0]", "column": "column"}
    facts = [
        Fact(
            "top_concentration",
            when="share",
            impact="top_share",
            severity="top_severity",
            number=str(len(model.metrics) + 1),
            values={**common, "share": percent_sql("top_share")},
        ),
        Fact(
            "leader",
            when="not share",
            impact="leader_impact",
            severity="'medium'",
            number="0",
            values={**common, "winner": "winner", "value": "winner_text"},
        ),
        Fact(
            "long_tail",
            when="not share",
            impact="long_tail_share",
            severity=f"if(long_tail_share < {segments.LOW_TAIL_SHARE}, 'high', 'low')",
            number="1",
            values={**common, "share": percent_sql("long_tail_share")},
        ),
        Fact(
            "concentration",
            when="not share",
            impact=f"concentration * {segments.CONCENTRATION_IMPACT}",
            severity=f"if(concentration >= {segments.HIGH_CONCENTRATION}, 'high', 'medium')",
            number="2",
            values={**common, "index": fixed_sql("concentration", 3)},
        ),
        Fact(
            "spread",
            when="not share",
            impact="spread_impact",
            severity="'medium'",
            number="3",
            values={**common, "winner": "winner", "loser": "loser", "spread": fixed_sql("spread", 2)},
        ),
    ]
    return collect_facts(rows, F.col("task_no"), facts), {}


def segment_tables(df: DataFrame, model: SemanticModel, task: AnalysisTask) -> RawOutputs:
    """The tables behind the findings of one task."""
    sql, dimension = model.metric(task.metric).sql, model.dimension(task.dimension).column
    return {
        "segment_rows": lambda: segments.segment_ranking(df, sql, dimension),
        "top_segments": lambda: segments.segment_ranking(df, sql, dimension, max_segments=segments.TOP_SEGMENTS),
        "summary": lambda: segments.segment_summary(df, sql, dimension).select("long_tail_share", "concentration"),
    }


def _counts(
    df: DataFrame, model: SemanticModel, profile: list[Row] | None, key: str | None, approx: bool
) -> DataFrame:
    """Null, distinct and duplicate counts; what the profile has counted already is not counted again."""
    dimensions = [item.column for item in model.dimensions]
    if profile is None:
        return checks.count_row(df, df.columns, dimensions, key, approx)
    known = {row["column"]: row for row in profile}
    nulls = {f"nulls{i}": known[name]["null_count"] for i, name in enumerate(df.columns)}
    distinct = {f"distinct{i}": known[name]["distinct_count"] for i, name in enumerate(dimensions)}
    keys = {"duplicates": known[key]["distinct_count"]} if key else {}
    if None in distinct.values() or None in keys.values() or not profile:
        counted = checks.count_row(df, (), dimensions, key, approx)
        return counted.withColumns({name: F.lit(count).cast("bigint") for name, count in nulls.items()})
    rows = profile[0]["row_count"]
    values = {"row_count": rows, **nulls, **distinct, **{name: rows - count for name, count in keys.items()}}
    fields = ", ".join(f"{name} bigint" for name in values)
    return small_table(df.sparkSession, [tuple(values.values())], fields)


def _shares(prefix: str, names: list[str]) -> str:
    """SQL for an array of (name, value) with the shares of the rows that ``prefix<i>`` counts."""
    entries = ", ".join(
        f"named_struct('ordinal', {i}, 'name', column_names[{i}], "
        f"'value', if(row_count > 0, {prefix}{i} / row_count, 0.0D))"
        for i in range(len(names))
    )
    return f"array({entries})"


def _listed(items: str, value: Callable[[str], str]) -> str:
    return f"array_join(transform({items}, x -> concat(x.name, ' (', {value('x.value')}, ')')), ', ')"


def diagnostics_module(
    df: DataFrame,
    model: SemanticModel,
    task_no: int,
    profile: list[Row] | None = None,
    approx: bool = False,
) -> Output:
    key = checks.key_candidate(df.columns)
    dimensions = list(model.dimensions)
    names = [item.name for item in dimensions]
    counts = _counts(df, model, profile, key, approx)

    worst_first = (
        "(a, b) -> case when a.value > b.value then -1 when a.value < b.value then 1 else a.ordinal - b.ordinal end"
    )
    rows = _named(counts, None, []).withColumn("column_names", F.lit(df.columns))
    rows = rows.withColumn(
        "worst", F.expr(f"slice(array_sort({_shares('nulls', df.columns)}, {worst_first}), 1, {checks.WORST_COLUMNS})")
    )
    facts = [
        Fact(
            "missing",
            when=f"worst[0].value > {checks.MISSING_RATE}",
            impact="worst[0].value",
            severity=f"if(worst[0].value > {checks.MISSING_HIGH_RATE}, 'high', 'medium')",
            dimensions="worst.name",
            number="0",
            values={"list": _listed("worst", percent_sql)},
        ),
        Fact(NO_ALERTS, impact=str(QUIET_IMPACT), severity="'low'", number="4"),
    ]
    if names:
        rows = rows.withColumn("column_names", F.lit(names)).withColumn(
            "near_unique",
            F.expr(f"filter({_shares('distinct', names)}, x -> x.value > {checks.CARDINALITY_RATIO})"),
        )
        some = f"slice(near_unique, 1, {LISTED_DIMENSIONS})"
        facts.append(
            Fact(
                "near_unique",
                when="size(near_unique) > 0",
                impact="array_max(near_unique.value)",
                severity="'medium'",
                dimensions=f"{some}.name",
                number="1",
                values={"list": _listed(some, percent_sql)},
            )
        )
    if key is not None:
        rows = rows.withColumn("key", F.lit(key))
        facts.append(
            Fact(
                "duplicates",
                when="duplicates > 0",
                impact="duplicates / greatest(row_count, 1)",
                severity="'high'",
                dimensions="array(key)",
                number="3",
                values={"count": "duplicates", "key": "key"},
            )
        )
    found = collect_facts(rows, F.lit(task_no), facts)
    raw: RawOutputs = {"missingness": lambda: checks.missing_table(counts, df.columns)}
    if names:
        raw["sparse_dimensions"] = lambda: checks.cardinality_table(counts, names)
    if key is not None:
        raw["duplicate_keys"] = lambda: counts.selectExpr("duplicates AS duplicate_count").withColumn(
            "key", F.lit(key)
        )

    if model.preferred_time_dimension and names:
        ranges = checks.instability(df, model.preferred_time_dimension, [item.column for item in dimensions], approx)
        raw["category_instability"] = lambda: ranges
        listed = ranges.withColumn("column_names", F.lit(names))
        unstable = listed.filter("unstable").agg(
            F.expr(
                "array_sort(collect_list(named_struct("
                "'ordinal', ordinal, 'name', column_names[ordinal], 'value', explosion_ratio))) AS unstable"
            )
        )
        some = f"slice(unstable, 1, {LISTED_DIMENSIONS})"
        explosion = Fact(
            "instability",
            when="size(unstable) > 0",
            impact=f"array_max(unstable.value) / {checks.INSTABILITY_SCALE}",
            severity="'medium'",
            dimensions=f"{some}.name",
            number="2",
            values={"list": _listed(some, lambda value: f"concat({fixed_sql(value, 2)}, 'x')")},
        )
        found = found.unionByName(collect_facts(_named(unstable, None, []), F.lit(task_no), [explosion]))
    return unless_others(found, F.col("kind") == NO_ALERTS, ("task_no",)), raw
