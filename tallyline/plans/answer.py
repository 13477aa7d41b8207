"""The answer to a question for which there is a SQL text: rows, insight, chart and what to ask next."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession

from tallyline.functions.small import small_table
from tallyline.operators.conversation import query_replies
from tallyline.operators.interpret import chart_hint, top_insight
from tallyline.plans.guarded import QUESTION_LIMITS, GuardedResult, guarded_query


@dataclass(frozen=True)
class Answer:
    question: str
    result: GuardedResult
    summary: str
    chart: str | None
    reply: str

    @property
    def rows(self) -> list[Row]:
        return self.result.rows


def answer(
    spark: SparkSession,
    question: str,
    text: str,
    row_limit: int = QUESTION_LIMITS[0],
    max_row_limit: int = QUESTION_LIMITS[1],
    allowed_tables: Sequence[str] = (),
    forbidden_tables: Sequence[str] = (),
    metric_names: Sequence[str] = (),
    dimension_names: Sequence[str] = (),
) -> Answer:
    """Run the text under the guard and read its capped result."""
    query = guarded_query(spark, text, row_limit, max_row_limit, allowed_tables, forbidden_tables)
    result = query.run()
    kept = spark.createDataFrame(result.rows, query.probe.schema).coalesce(1)
    insight = top_insight(
        kept,
        question,
        metric_names,
        dimension_names,
        row_count=result.row_count,
        duration_ms=result.duration_ms,
        truncated=result.truncated,
    )
    summary = insight.first()["insight"]
    return Answer(
        question,
        result,
        summary,
        chart_hint(result.columns, result.row_count > 0),
        _reply(spark, result, summary, metric_names, dimension_names),
    )


def _reply(
    spark: SparkSession, result: GuardedResult, summary: str, metrics: Sequence[str], dimensions: Sequence[str]
) -> str:
    """What a conversation says to the result: the insight, the first row and follow-up questions."""
    first = str(dict(zip(result.columns, result.rows[0], strict=True))) if result.rows else None
    schema = "summary string, row_count bigint, columns array<string>, first_row string"
    row = small_table(spark, [(summary, result.row_count, result.columns, first)], schema)
    return query_replies(row, metrics, dimensions).first()["reply"]
