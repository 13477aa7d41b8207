"""Metric text to aggregate expression."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The only metric form that is accepted.
METRIC_PATTERN = r"(?i)^\s*(sum|avg|min|max|count)\s*\(\s*(\*|[a-zA-Z_][a-zA-Z0-9_]*)\s*\)\s*$"

_AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def column(name: str) -> Column:
    """A top-level column, whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def metric_parts(sql: str) -> tuple[str, str]:
    """The function and the column of a metric, or an error when the text is anything else."""
    match = re.match(METRIC_PATTERN, sql)
    if match is None:
        raise ValueError(f"Unsafe metric expression {sql!r}: only SUM/AVG/MIN/MAX/COUNT(column|*) are allowed")
    return match.group(1).lower(), match.group(2)


def metric_column(sql: str, columns: Iterable[str]) -> Column:
    """The aggregate for a metric text; the column must be one of ``columns``."""
    function, name = metric_parts(sql)
    if name == "*":
        if function != "count":
            raise ValueError(f"{function.upper()}(*) is not an aggregate")
        return F.count(F.lit(1))
    if name not in set(columns):
        raise ValueError(f"Metric {sql!r} references unknown column: {name}")
    return _AGGREGATES[function](column(name))
