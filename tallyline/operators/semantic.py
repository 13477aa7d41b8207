"""Metrics and dimensions derived from a column profile, and their checks.

The tables here have one row for each column, metric or dimension of a data set, so they stay small whatever the
size of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.metrics import METRIC_PATTERN, metric_column
from tallyline.functions.small import small_table
from tallyline.models import Dimension, Metric, SemanticConfig, SemanticModel

# Fixed values.
METRIC_CONFIDENCE = 0.8
DIMENSION_CONFIDENCE = 0.85
TIME_CONFIDENCE = 0.9
TIME_GRAIN = "day"
DEFAULT_RULES = ("Use only known columns", "Prefer additive metrics first")
BUSINESS_CONTEXT_RULE = "Business context: {context}"

METRICS_SCHEMA = "place int, name string, sql string, description string, confidence double, caveats array<string>"
DIMENSIONS_SCHEMA = "place int, name string, column string, grain string, description string, confidence double"


def metrics_from_profile(profile: DataFrame) -> DataFrame:
    """A total for each measure, in schema order. A profile has one row per column, so one task is enough."""
    place = F.row_number().over(Window.orderBy("ordinal"))
    return profile.filter(F.col("role") == "measure").withColumn("place", place).select(
        "place",
        F.concat(F.lit("total_"), F.col("column")).alias("name"),
        F.concat(F.lit("SUM("), F.col("column"), F.lit(")")).alias("sql"),
        F.concat(F.lit("Total "), F.col("column")).alias("description"),
        F.lit(METRIC_CONFIDENCE).alias("confidence"),
        F.array().cast("array<string>").alias("caveats"),
    )


def dimensions_from_profile(profile: DataFrame) -> DataFrame:
    """The dimension columns, then the first time column with a daily grain."""
    is_time = F.col("role") == "time"
    in_role = F.row_number().over(Window.partitionBy("role").orderBy("ordinal"))
    kept = (
        profile.filter(F.col("role").isin("dimension", "time"))
        .withColumn("place", in_role)
        .filter(~is_time | (F.col("place") == 1))
        .withColumn("place", F.row_number().over(Window.orderBy(is_time, "ordinal")))
    )
    described = F.when(is_time, "Time dimension on ").otherwise("Dimension based on ")
    return kept.select(
        "place",
        F.col("column").alias("name"),
        F.col("column"),
        F.when(is_time, F.lit(TIME_GRAIN)).alias("grain"),
        F.concat(described, F.col("column")).alias("description"),
        F.when(is_time, F.lit(TIME_CONFIDENCE)).otherwise(F.lit(DIMENSION_CONFIDENCE)).alias("confidence"),
    )


def build_semantic_model(
    dataset_name: str, table_name: str, profile: DataFrame, business_context: str | None = None
) -> SemanticModel:
    """Read the two small tables into the model the report is planned from."""
    metrics = metrics_from_profile(profile).orderBy("place").collect()
    dimensions = dimensions_from_profile(profile).orderBy("place").collect()
    rules = list(DEFAULT_RULES)
    if business_context:
        rules.append(BUSINESS_CONTEXT_RULE.format(context=business_context))
    times = [row["column"] for row in dimensions if row["grain"]]
    return SemanticModel(
        dataset_name=dataset_name,
        table_name=table_name,
        metrics=tuple(Metric(r["name"], r["sql"], r["description"], r["confidence"]) for r in metrics),
        dimensions=tuple(
            Dimension(r["name"], r["column"], r["grain"], r["description"], r["confidence"]) for r in dimensions
        ),
        business_rules=tuple(rules),
        preferred_time_dimension=times[0] if times else None,
    )


def model_from_config(
    dataset_name: str, table_name: str, config: SemanticConfig, time_column: str | None = None
) -> SemanticModel:
    """A model from hand-written metric expressions and dimension names."""
    return SemanticModel(
        dataset_name=dataset_name,
        table_name=table_name,
        metrics=tuple(
            Metric(item["name"], item["expression"], item.get("description", ""))
            for item in config.metrics
            if item.get("expression")
        ),
        dimensions=tuple(
            Dimension(
                item["name"],
                item.get("column", item["name"]),
                TIME_GRAIN if item["name"] == time_column else None,
                item.get("description", ""),
            )
            for item in config.dimensions
        ),
        business_rules=config.business_rules,
        preferred_time_dimension=time_column,
    )


def metrics_table(df: DataFrame, model: SemanticModel) -> DataFrame:
    rows = [(i, m.name, m.sql, m.description, m.confidence, list(m.caveats)) for i, m in enumerate(model.metrics, 1)]
    return small_table(df.sparkSession, rows, METRICS_SCHEMA)


def dimensions_table(df: DataFrame, model: SemanticModel) -> DataFrame:
    rows = [
        (i, d.name, d.column, d.grain, d.description, d.confidence) for i, d in enumerate(model.dimensions, 1)
    ]
    return small_table(df.sparkSession, rows, DIMENSIONS_SCHEMA)


def semantic_problems(
    metrics: DataFrame,
    dimensions: DataFrame,
    columns: Sequence[str],
    rules: DataFrame | None = None,
    time_column: str | None = None,
) -> DataFrame:
    """Everything that makes a model unusable: one row ``(kind, name, detail)`` per problem.

    ``columns`` are the names of the table's columns; ``rules`` has the business rules in ``rule``. Rules are reduced
    to their distinct words before these are looked up, so a word that most rules use is looked up once.
    """

    def found(rows: DataFrame, kind: str, name: str, detail: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(detail).alias("detail"))

    parsed = metrics.withColumns(
        {
            "formed": F.coalesce(F.col("sql").rlike(METRIC_PATTERN), F.lit(False)),
            "function": F.lower(F.regexp_extract("sql", METRIC_PATTERN, 1)),
            "target": F.regexp_extract("sql", METRIC_PATTERN, 2),
        }
    )
    starred = F.col("target") == "*"
    unsafe = parsed.filter(~F.col("formed") | (starred & (F.col("function") != "count")))
    lost = parsed.filter(F.col("formed") & ~starred & ~F.col("target").isin(*columns))
    astray = dimensions.filter(F.col("column").isNull() | ~F.col("column").isin(*columns))
    problems = (
        found(unsafe, "unsafe_metric", "name", "sql")
        .unionByName(found(lost, "unknown_metric_column", "name", "target"))
        .unionByName(found(astray, "unknown_dimension_column", "name", "column"))
    )
    if time_column is not None and time_column not in columns:
        row = small_table(metrics.sparkSession, [(time_column,)], "name string")
        problems = problems.unionByName(found(row, "unknown_time_column", "name", "name"))
    if rules is not None:
        word = F.explode(F.regexp_extract_all("rule", F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"), F.lit(0)))
        words = rules.select(word.alias("word")).distinct()
        words = words.filter(F.col("word").startswith("total_") | F.col("word").startswith("dim_"))
        known = metrics.select(F.col("name").alias("known")).filter(F.col("known").startswith("total_"))
        known = known.unionByName(dimensions.select(F.concat(F.lit("dim_"), F.col("name")).alias("known")))
        unknown = words.join(known, F.col("word") == F.col("known"), "left_anti")
        problems = problems.unionByName(found(unknown, "unknown_rule_reference", "word", "word"))
    return problems


def validate_model(df: DataFrame, model: SemanticModel) -> SemanticModel:
    """Return the model, or fail with everything that is wrong with it."""
    problems = semantic_problems(
        metrics_table(df, model),
        dimensions_table(df, model),
        df.columns,
        small_table(df.sparkSession, [(rule,) for rule in model.business_rules], "rule string"),
        model.preferred_time_dimension,
    ).collect()
    if problems:
        listed = "; ".join(sorted(f"{p['kind']}: {p['name']} ({p['detail']})" for p in problems))
        raise ValueError(f"Invalid semantic model: {listed}")
    return model


def evaluate_metrics(df: DataFrame, metrics: tuple[Metric, ...]) -> DataFrame:
    """All metrics over the whole table, in one scan."""
    return df.agg(*[metric_column(metric.sql, df.columns).alias(metric.name) for metric in metrics])


def explain_metrics(metrics: DataFrame, dimensions: DataFrame, time_column: str | None) -> DataFrame:
    """Each metric with its definition and the dimensions used with it.

    Both tables are small, and meet in one row that is then unfolded by metric.
    """
    common = dimensions if time_column is None else dimensions.filter(F.col("name") != time_column)
    entry = F.struct(*["place", "name", "description", "sql", "caveats"])
    both = metrics.select(entry.alias("metric")).unionByName(
        common.select(F.struct("place", "name").alias("dimension")), allowMissingColumns=True
    )
    listed = both.agg(
        F.array_sort(F.collect_list("metric")).alias("metrics"),
        F.array_sort(F.collect_list("dimension"))["name"].alias("dimensions"),
    )
    return listed.select(F.inline("metrics"), "dimensions").select(
        F.col("name").alias("metric_name"),
        "description",
        "sql",
        F.col("dimensions").alias("dimensions_commonly_used"),
        "caveats",
    )


def explain_metric(df: DataFrame, model: SemanticModel, name: str) -> DataFrame:
    model.metric(name)
    explained = explain_metrics(metrics_table(df, model), dimensions_table(df, model), model.preferred_time_dimension)
    return explained.filter(F.col("metric_name") == name)
