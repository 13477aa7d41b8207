"""Checking a log of SQL texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import sqltext
from tallyline.functions.metrics import column
from tallyline.functions.small import small_table


def normalize_log(log: DataFrame, text: str = "sql") -> DataFrame:
    return log.withColumn("normalized_sql", sqltext.normalize(column(text)))


def limit_log(log: DataFrame, row_limit: int, max_row_limit: int, text: str = "sql") -> DataFrame:
    """Each text under a row limit: ``limited_sql, rewritten, warning``."""
    limited = log.withColumn("_limited", sqltext.limited(column(text), row_limit, max_row_limit))
    return limited.select(
        *map(column, log.columns),
        F.col("_limited.sql").alias("limited_sql"),
        F.col("_limited.rewritten").alias("rewritten"),
        F.col("_limited.warning").alias("warning"),
    )


def audit_log(
    log: DataFrame,
    forbidden_tables: Sequence[str] = (),
    allowed_tables: Sequence[str] = (),
    text: str = "sql",
) -> DataFrame:
    """Each text without comments, the tables it reads, what is wrong with it and whether it passes."""
    return (
        log.withColumn("checked_sql", sqltext.without_comments(column(text)))
        .withColumns(
            {
                "table_refs": sqltext.table_refs(F.col("checked_sql")),
                "_words": sqltext.guarded_words(F.col("checked_sql")),
            }
        )
        .withColumn(
            "errors",
            sqltext.problems(
                F.col("checked_sql"), F.col("_words"), F.col("table_refs"), forbidden_tables, allowed_tables
            ),
        )
        .withColumn("passed", F.size("errors") == 0)
        .drop("_words")
    )


def check_text(
    spark: SparkSession, text: str, forbidden_tables: Sequence[str] = (), allowed_tables: Sequence[str] = ()
) -> list[str]:
    """The reasons to refuse one text, by the same rules."""
    one = small_table(spark, [(text,)], "sql string")
    return audit_log(one, forbidden_tables, allowed_tables).first()["errors"]
