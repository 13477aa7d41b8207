"""Running one SQL text under the guard."""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import sqltext
from tallyline.functions.small import small_table
from tallyline.operators.sql_audit import check_text

# The default and the largest row limit of a question.
QUESTION_LIMITS = (100, 1000)
PATH = "a path"


class UnsafeQuery(ValueError):
    """The text is not a single read-only query over allowed tables."""


@dataclass(frozen=True)
class GuardedResult:
    sql: str
    columns: list[str]
    rows: list[Row]
    row_count: int
    duration_ms: int
    truncated: bool
    warnings: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class GuardedQuery:
    """A checked query: ``sql`` is the text that runs, as it is; ``probe`` its first ``cap`` rows and one more."""

    sql: str
    cap: int
    warnings: list[str]
    probe: DataFrame

    @property
    def data(self) -> DataFrame:
        """The rows under the cap; ``truncated`` and ``run`` tell whether there are more."""
        return self.probe.limit(self.cap)

    def truncated(self) -> bool:
        return self.probe.count() > self.cap

    def run(self) -> GuardedResult:
        """Fetch the rows. One row beyond the cap is read, to tell whether the result was cut."""
        start = time.perf_counter()
        rows = self.probe.collect()
        duration_ms = int((time.perf_counter() - start) * 1000)
        kept = rows[: self.cap]
        return GuardedResult(
            self.sql, self.probe.columns, kept, len(kept), duration_ms, len(rows) > self.cap, self.warnings
        )


@dataclass(frozen=True)
class Relation:
    """A table or view of an analysed plan: its full name in lower case, and the views it is read through, outermost first.

    What is read by a path and not by a name has no name.
    """

    name: tuple[str, ...]
    through: tuple[tuple[str, ...], ...] = ()


def relations(query: DataFrame) -> list[Relation]:
    """All tables and views that the analysed plan of a query reads, those inside views and sub-queries too.

    The analyser has settled by then what each name means: which names are the query's own, in which scope, and what
    ``IDENTIFIER`` stands for. Nothing is run.
    """
    found: list[Relation] = []
    waiting = [(query._jdf.queryExecution().analyzed(), ())]
    while waiting:
        node, through = waiting.pop()
        name = _relation_name(node)
        if name is not None:
            found.append(Relation(name, through))
            through = (*through, name) if node.getClass().getSimpleName() == "View" else through
        for inner in (node.children(), node.subqueries()):
            waiting += [(inner.apply(place), through) for place in range(inner.size())]
    return found


def _relation_name(node) -> tuple[str, ...] | None:
    """The name of a plan node that is a table or view; empty for files and other sources without a name."""
    kind = node.getClass().getSimpleName()
    if kind == "View":
        return _parts(node.desc().identifier())
    if kind == "HiveTableRelation":
        return _parts(node.tableMeta().identifier())
    if kind in ("LogicalRelation", "LogicalRelationWithTable", "StreamingRelation"):
        table = node.catalogTable() if kind != "StreamingRelation" else None
        return _parts(table.get().identifier()) if table is not None and table.isDefined() else ()
    if kind == "DataSourceV2Relation":
        if not node.catalog().isDefined() or not node.identifier().isDefined():
            return ()
        identifier = node.identifier().get()
        return tuple(part.lower() for part in (node.catalog().get().name(), *identifier.namespace(), identifier.name()))
    return None


def _parts(identifier) -> tuple[str, ...]:
    """Catalog, database and name of a table; temporary views have only a name."""
    parts = (identifier.catalog(), identifier.database())
    return (*(part.get().lower() for part in parts if part.isDefined()), identifier.table().lower())


def _matches(relation: tuple[str, ...], name: str, here: tuple[str, ...]) -> bool:
    """Whether a relation is the table of this name, both taken from the current catalog and database."""
    parts = tuple(part.strip("` ").lower() for part in name.split("."))
    full = lambda one: (*here[: max(0, len(here) + 1 - len(one))], *one)
    return full(relation) == full(parts)


def refused_relations(
    spark: SparkSession, found: Sequence[Relation], forbidden_tables: Sequence[str], allowed_tables: Sequence[str]
) -> list[str]:
    """Relations that are forbidden, or not allowed where an allow-list is given.

    What an allowed view reads is the view's business. Any other view is looked through: a forbidden table is refused
    however deep it is read. A source without a name is refused unless a view reads it.
    """
    here = (spark.catalog.currentCatalog().lower(), spark.catalog.currentDatabase().lower())
    last = {name.lower() for name in forbidden_tables if "." not in name}

    def listed(one: tuple[str, ...], names: Sequence[str]) -> bool:
        return any(_matches(one, name, here) for name in names)

    def refused(one: Relation) -> bool:
        if any(listed(view, allowed_tables) for view in one.through):
            return False
        if not one.name:
            return not one.through
        if one.name[-1] in last or listed(one.name, forbidden_tables):
            return True
        return bool(allowed_tables) and not one.through and not listed(one.name, allowed_tables)

    return sorted({".".join(one.name) or PATH for one in found if refused(one)})


def guarded_query(
    spark: SparkSession,
    text: str,
    row_limit: int = QUESTION_LIMITS[0],
    max_row_limit: int = QUESTION_LIMITS[1],
    allowed_tables: Sequence[str] = (),
    forbidden_tables: Sequence[str] = (),
) -> GuardedQuery:
    """Check a text and prepare its result, or raise ``UnsafeQuery``.

    Two locks hold. The text is checked by the rules for texts, which also refuse any name after FROM or JOIN that is
    forbidden or not allowed, be it of a table or of the text's own; and the tables of the analysed plan are checked
    whatever way the text names them. It runs as it stands, under a limit of rows around it: ``row_limit``, or
    ``max_row_limit`` if the text has a limit of its own.
    """
    text_row = small_table(spark, [(text,)], "text string").select(sqltext.normalize(F.col("text")).alias("sql"))
    checked = text_row.select(
        "sql",
        sqltext.limited(F.col("sql"), row_limit, max_row_limit)["warning"].alias("warning"),
        sqltext.stated_limit(F.col("sql")).alias("stated"),
    ).first()
    sql = checked["sql"].rstrip(";")
    errors = check_text(spark, sql, forbidden_tables, allowed_tables)
    if re.search(r"\b\w+\s*\.\s*`", sql):
        errors.append("Paths are not allowed as tables")
    if errors:
        raise UnsafeQuery("; ".join(errors))
    try:
        query = spark.sql(sql)
    except AnalysisException as error:
        if error.getCondition() != "TABLE_OR_VIEW_NOT_FOUND":
            raise
        name = error.getMessageParameters()["relationName"].replace("`", "")
        raise UnsafeQuery(sqltext.DISALLOWED_TABLES.format(tables=name)) from None
    hidden = refused_relations(spark, relations(query), forbidden_tables, allowed_tables)
    if hidden:
        raise UnsafeQuery(sqltext.DISALLOWED_TABLES.format(tables=", ".join(hidden)))
    cap = sqltext.safe_limit(row_limit, max_row_limit) if checked["stated"] is None else max_row_limit
    warnings = [checked["warning"]] if checked["warning"] else []
    return GuardedQuery(sql, cap, warnings, query.limit(cap + 1))
