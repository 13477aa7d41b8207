"""Configuration objects kept on the driver, and the schemas of the result tables."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import types as T

EVIDENCE_TYPE = T.StructType(
    [
        T.StructField("module", T.StringType()),
        T.StructField("query_id", T.StringType()),
        T.StructField("table_name", T.StringType()),
    ]
)

FINDING_FIELDS = [
    T.StructField("title", T.StringType()),
    T.StructField("observation", T.StringType()),
    T.StructField("interpretation", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("dimensions", T.ArrayType(T.StringType())),
    T.StructField("impact_score", T.DoubleType()),
    T.StructField("confidence_score", T.DoubleType()),
    T.StructField("business_relevance_score", T.DoubleType()),
    T.StructField("severity", T.StringType()),
    T.StructField("caveats", T.ArrayType(T.StringType())),
    T.StructField("evidence", T.ArrayType(EVIDENCE_TYPE)),
]

# Findings in report order: the task that made them, then their place within the task.
FINDINGS_SCHEMA = T.StructType(
    [
        T.StructField("dataset_name", T.StringType()),
        T.StructField("task_no", T.IntegerType()),
        T.StructField("finding_no", T.IntegerType()),
        *FINDING_FIELDS,
    ]
)

DATASET_SCHEMA = T.StructType(
    [
        T.StructField("dataset_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("profile_path", T.StringType()),
        T.StructField("semantic_path", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Metric:
    """A named aggregate such as ``SUM(revenue)``."""

    name: str
    sql: str
    description: str = ""
    confidence: float = 0.8
    caveats: tuple[str, ...] = ()


@dataclass(frozen=True)
class Dimension:
    """A column to group by; a time dimension carries a grain."""

    name: str
    column: str
    grain: str | None = None
    description: str = ""
    confidence: float = 0.85


@dataclass(frozen=True)
class SemanticModel:
    """The metrics and dimensions of one table."""

    dataset_name: str
    table_name: str
    metrics: tuple[Metric, ...] = ()
    dimensions: tuple[Dimension, ...] = ()
    business_rules: tuple[str, ...] = ()
    preferred_time_dimension: str | None = None

    def metric(self, name: str) -> Metric:
        for item in self.metrics:
            if item.name == name:
                return item
        raise ValueError(f"Unknown metric: {name}")

    def dimension(self, name: str) -> Dimension:
        """Look a dimension up by its name or by its column."""
        for item in self.dimensions:
            if name in (item.name, item.column):
                return item
        raise ValueError(f"Unknown dimension: {name}")

    def time_column(self) -> str:
        if not self.preferred_time_dimension:
            raise ValueError("No preferred time dimension is configured")
        return self.preferred_time_dimension

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, payload: dict[str, Any]) -> SemanticModel:
        return cls(
            dataset_name=payload["dataset_name"],
            table_name=payload["table_name"],
            metrics=tuple(
                Metric(**{**item, "caveats": tuple(item.get("caveats") or ())})
                for item in payload.get("metrics") or ()
            ),
            dimensions=tuple(Dimension(**item) for item in payload.get("dimensions") or ()),
            business_rules=tuple(payload.get("business_rules") or ()),
            preferred_time_dimension=payload.get("preferred_time_dimension"),
        )


@dataclass(frozen=True)
class SemanticConfig:
    """Hand-written settings for one project: names worth showing, tables to keep out, metric expressions."""

    project: str = "default"
    tables: tuple[dict[str, Any], ...] = ()
    columns: tuple[dict[str, Any], ...] = ()
    metrics: tuple[dict[str, str], ...] = ()
    dimensions: tuple[dict[str, str], ...] = ()
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    forbidden_tables: tuple[str, ...] = ()
    preferred_views: tuple[str, ...] = ()
    business_rules: tuple[str, ...] = ()
    examples: tuple[dict[str, str], ...] = ()

    @classmethod
    def from_dict(cls, payload: dict[str, Any]) -> SemanticConfig:
        known = {name: payload[name] for name in cls.__dataclass_fields__ if payload.get(name) is not None}
        return cls(**{name: tuple(value) if isinstance(value, list) else value for name, value in known.items()})


@dataclass(frozen=True)
class AnalysisTask:
    """One step of a report."""

    module: str
    metric: str | None = None
    dimension: str | None = None
    grain: str | None = None
    priority: int = 1
