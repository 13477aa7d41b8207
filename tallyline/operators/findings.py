"""Findings: building, scoring, ranking and the executive summary.

A module reduces its data to a few statistics rows. Each row yields facts, which are what was found and the values to
word it with. The facts of all modules are then joined with the wordings.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.functions.metrics import column
from tallyline.functions.ordered import MAX_GROUP_ROWS, ordered_rows
from tallyline.functions.small import small_table
from tallyline.functions.text import contains_any, fill
from tallyline.operators.finding_texts import FINDING_TEXTS

# Weights, thresholds and defaults of the score.
IMPACT_WEIGHT = 0.45
CONFIDENCE_WEIGHT = 0.35
RELEVANCE_WEIGHT = 0.20
HIGH_SCORE = 0.7
MEDIUM_SCORE = 0.4
NUMBER_PATTERN = r"-?\d+(?:\.\d+)?"
NUMBER_SCALE = 100.0
IMPACT_WITHOUT_NUMBER = 0.3
CONFIDENCE_WITH_EVIDENCE = 0.75
CONFIDENCE_WITHOUT_EVIDENCE = 0.4
CAVEAT_PENALTY = 0.08
CAVEAT_PENALTY_LIMIT = 0.3
CONFIDENCE_FLOOR = 0.1
RELEVANCE_BASE = 0.5
RELEVANCE_METRIC = 0.2
RELEVANCE_RISK = 0.15
RELEVANCE_MONEY = 0.1
RISK_WORDS = ("risk",)
MONEY_WORDS = ("revenue", "sales")

# Scores are weighed as decimals, since equal sums of doubles can differ in their last digit and swap ranks.
SCORE_TYPE = "decimal(22,20)"

# The executive summary.
SUMMARY_FINDINGS = 3
SUMMARY_RISKS = 3
SUMMARY_CAVEATS = 5
SUMMARY_FOLLOW_UPS = 2
NO_FINDINGS = "No material findings"
NO_CAVEATS = "Summary is constrained to deterministic evidence only."
FOLLOW_UP = "Validate drivers behind: {title}"
NO_FOLLOW_UP = "Collect more data to produce actionable findings."

DATASET_KEY = ("dataset_name",)


@dataclass(frozen=True)
class Fact:
    """One possible finding of a statistics row, in SQL over the columns of the row.

    The row has ``metric`` and ``dimensions`` columns; ``values`` fill the places of the wording.
    """

    kind: str
    impact: str
    severity: str
    when: str = "true"
    dimensions: str = "dimensions"
    caveats: str = "null"
    number: str = "0"
    metric: str = "metric"
    values: dict[str, str] = field(default_factory=dict)

    def sql(self) -> str:
        pairs = "".join(f", '{name}', string({value})" for name, value in self.values.items())
        return (
            f"if({self.when}, named_struct('kind', '{self.kind}', 'finding_no', int({self.number}), "
            f"'metric', {self.metric}, 'dimensions', {self.dimensions}, "
            f"'impact_score', least(1.0D, double({self.impact})), "
            f"'severity', {self.severity}, 'own_caveats', cast({self.caveats} AS array<string>), "
            f"'values', map('metric', {self.metric}{pairs})), null)"
        )


def collect_facts(rows: DataFrame, task_no: Column, facts: Sequence[Fact]) -> DataFrame:
    """The facts that hold for each row, all from one pass over the rows."""
    never = Fact("headline", impact="0", severity="'low'", when="false")
    made = ", ".join(fact.sql() for fact in facts or [never])
    return rows.select(
        task_no.cast("int").alias("task_no"), F.expr(f"inline(filter(array({made}), f -> f is not null))")
    )


def _pieces(template: str) -> list[dict[str, str | None]]:
    return [
        {"text": part, "name": None} if place else {"text": None, "name": part}
        for text, name, _, _ in string.Formatter().parse(template)
        for place, part in ((True, text), (False, name))
        if part
    ]


def _texts(spark: SparkSession) -> DataFrame:
    """The wordings as a table, one row per kind of finding."""
    pieces = "array<struct<text:string,name:string>>"
    return small_table(
        spark,
        [
            (
                kind,
                _pieces(text.title),
                _pieces(text.observation),
                _pieces(text.interpretation),
                _pieces(text.query_id),
                text.confidence,
                text.relevance,
                text.module,
                list(text.caveats),
            )
            for kind, text in FINDING_TEXTS.items()
        ],
        f"kind string, title {pieces}, observation {pieces}, interpretation {pieces}, query_id {pieces}, "
        "confidence double, relevance double, module string, caveats array<string>",
    )


def _wording(name: str) -> Column:
    return F.expr(
        f"array_join(transform({name}, p -> coalesce(p.text, values[p.name], 'None')), '') AS {name}"
    )


def write_out(facts: DataFrame, dataset_name: str, table_name: str) -> DataFrame:
    """Turn facts into findings. The wordings are a fixed table of a few rows, so they are sent to every task."""
    return facts.join(F.broadcast(_texts(facts.sparkSession)), "kind").select(
        F.lit(dataset_name).alias("dataset_name"),
        "task_no",
        "finding_no",
        *map(_wording, ("title", "observation", "interpretation")),
        "metric",
        "dimensions",
        "impact_score",
        F.col("confidence").alias("confidence_score"),
        F.col("relevance").alias("business_relevance_score"),
        "severity",
        F.coalesce("own_caveats", "caveats").alias("caveats"),
        F.array(F.struct("module", _wording("query_id"), F.lit(table_name).alias("table_name"))).alias("evidence"),
    )


def _exact(value: float) -> Column:
    return F.lit(Decimal(str(value)))


def _clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def _given(score: str, derived: Column) -> Column:
    return F.when(F.col(score) > 0, F.col(score)).otherwise(derived)


def _derived_impact() -> Column:
    sizes = F.transform(
        F.regexp_extract_all("observation", F.lit(NUMBER_PATTERN), F.lit(0)), lambda text: F.abs(text.cast("double"))
    )
    from_number = F.least(F.lit(1.0), F.array_max(sizes) / NUMBER_SCALE)
    return F.when(F.size(sizes) > 0, from_number).otherwise(F.lit(IMPACT_WITHOUT_NUMBER))


def _derived_confidence() -> Column:
    base = F.when(F.size("evidence") > 0, _exact(CONFIDENCE_WITH_EVIDENCE)).otherwise(_exact(CONFIDENCE_WITHOUT_EVIDENCE))
    caveats = F.greatest(F.size("caveats"), F.lit(0))
    penalty = F.least(_exact(CAVEAT_PENALTY_LIMIT), caveats * _exact(CAVEAT_PENALTY))
    return F.greatest(_exact(CONFIDENCE_FLOOR), base - penalty).cast("double")


def _derived_relevance() -> Column:
    def bonus(condition: Column, amount: float) -> Column:
        return F.when(condition, _exact(amount)).otherwise(_exact(0.0))

    has_metric = F.coalesce(F.col("metric") != "", F.lit(False))
    risk = contains_any(F.col("title"), RISK_WORDS) | contains_any(F.col("observation"), RISK_WORDS)
    money = contains_any(F.col("observation"), MONEY_WORDS)
    total = (
        _exact(RELEVANCE_BASE)
        + bonus(has_metric, RELEVANCE_METRIC)
        + bonus(risk, RELEVANCE_RISK)
        + bonus(money, RELEVANCE_MONEY)
    )
    return F.least(_exact(1.0), total).cast("double")


def score_findings(findings: DataFrame) -> DataFrame:
    """Fill in missing scores, combine them and set the severity from the combined score."""
    combined = (
        F.col("impact_score").cast(SCORE_TYPE) * _exact(IMPACT_WEIGHT)
        + F.col("confidence_score").cast(SCORE_TYPE) * _exact(CONFIDENCE_WEIGHT)
        + F.col("business_relevance_score").cast(SCORE_TYPE) * _exact(RELEVANCE_WEIGHT)
    ).cast("double")
    severity = F.when(F.col("combined_score") >= HIGH_SCORE, "high").when(
        F.col("combined_score") >= MEDIUM_SCORE, "medium"
    )
    return (
        findings.withColumns(
            {
                "impact_score": _clamp(_given("impact_score", _derived_impact())),
                "confidence_score": _clamp(_given("confidence_score", _derived_confidence())),
                "business_relevance_score": _clamp(_given("business_relevance_score", _derived_relevance())),
            }
        )
        .withColumn("combined_score", combined)
        .withColumn("severity", severity.otherwise("low"))
    )


def rank_findings(
    findings: DataFrame,
    keys: Sequence[str] = DATASET_KEY,
    tie: Sequence[str] = ("task_no", "finding_no"),
    max_group_rows: int | None = MAX_GROUP_ROWS,
    count_in: DataFrame | None = None,
) -> DataFrame:
    """Score the findings and number them within each data set, best first, equal ones in report order.

    ``max_group_rows`` and ``count_in`` are as in ``ordered_rows``.
    """
    order = [F.col("combined_score").desc(), *map(column, tie)]
    rows = ordered_rows(score_findings(findings), keys, order, max_group_rows, count_in)
    return rows.number("rank").done()


def executive_summary(
    findings: DataFrame, keys: Sequence[str] = DATASET_KEY, tie: Sequence[str] = ("task_no", "finding_no")
) -> DataFrame:
    """One row per data set, from its first findings only.

    Risks are the first findings of high severity. Ranks follow the score and severity is a threshold on it, so they
    are the first findings too. With a limit on the rank every task keeps its own first rows before the shuffle, so a
    data set may have any number of findings.
    """
    top = max(SUMMARY_FINDINGS, SUMMARY_RISKS)
    best = rank_findings(findings, keys, tie, max_group_rows=None).filter(F.col("rank") <= top)

    def in_order(condition: Column, value: str) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, F.struct("rank", value))))[value]

    first = F.col("rank") <= SUMMARY_FINDINGS
    risky = (F.col("severity") == "high") & (F.col("rank") <= SUMMARY_RISKS)
    summary = best.groupBy(*map(column, keys)).agg(
        in_order(first, "title").alias("top_findings"),
        in_order(risky, "observation").alias("key_risks"),
        F.flatten(in_order(first, "caveats")).alias("caveats"),
    )
    caveats = F.when(F.size("caveats") > 0, F.slice("caveats", 1, SUMMARY_CAVEATS)).otherwise(
        F.array(F.lit(NO_CAVEATS))
    )
    follow_ups = F.transform(
        F.slice("top_findings", 1, SUMMARY_FOLLOW_UPS), lambda title: fill(FOLLOW_UP, title=title)
    )
    return summary.select(
        *map(column, keys),
        F.col("top_findings")[0].alias("headline"),
        "top_findings",
        "key_risks",
        caveats.alias("caveats"),
        follow_ups.alias("follow_up_questions"),
    )


def summary_or_default(findings: DataFrame, dataset_name: str) -> DataFrame:
    """The summary of one data set, with the default texts when it has no findings."""
    default = small_table(
        findings.sparkSession,
        [(dataset_name, NO_FINDINGS, [], [], [NO_CAVEATS], [NO_FOLLOW_UP])],
        "dataset_name string, headline string, top_findings array<string>, key_risks array<string>, "
        "caveats array<string>, follow_up_questions array<string>",
    )
    found = executive_summary(findings).withColumn("_found", F.lit(True))
    both = found.unionByName(default.withColumn("_found", F.lit(False)))
    return unless_others(both, ~F.col("_found"), DATASET_KEY).drop("_found")


def unless_others(rows: DataFrame, fallback: Column, keys: Sequence[str]) -> DataFrame:
    """Drop the fallback row of a key that has other rows. For tables with a few rows per key."""
    others = F.count_if(~fallback).over(Window.partitionBy(*map(column, keys)))
    return rows.withColumn("_others", others).filter(~fallback | (F.col("_others") == 0)).drop("_others")
