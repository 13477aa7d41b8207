"""Data sets under one shared folder: load, look, profile, model, analyse, ask."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyline.functions.text import clean_name
from tallyline.models import SemanticConfig, SemanticModel
from tallyline.operators.conversation import previous_queries, semantic_hint
from tallyline.operators.profile import DatasetProfile, profile_dataset, role_profile
from tallyline.operators.semantic import build_semantic_model, explain_metric, validate_model
from tallyline.plans.answer import Answer, answer
from tallyline.plans.report import AnalysisReport, run_analysis
from tallyline.sources import store
from tallyline.sources.catalog import DatasetCatalog, RegisteredDataset
from tallyline.sources.describe import Preview, preview
from tallyline.sources.ingest import IngestResult, ingest_csv, ingest_parquet


class Workspace:
    """Every load writes a new folder and every change a new catalog entry, so readers never see half a table."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.catalog = DatasetCatalog(spark, f"{self.root}/catalog")

    def load_csv(
        self,
        path: str,
        dataset: str,
        table: str | None = None,
        replace: bool = False,
        schema: T.StructType | str | None = None,
    ) -> IngestResult:
        location = self._new_location(dataset, table, replace)
        result = ingest_csv(self.spark, path, table or dataset, True, dataset, schema, location)
        return self._register(result, location)

    def load_parquet(
        self, path: str, dataset: str, table: str | None = None, replace: bool = False
    ) -> IngestResult:
        location = self._new_location(dataset, table, replace)
        return self._register(
            ingest_parquet(self.spark, path, table or dataset, True, dataset, location), location
        )

    def _new_location(self, dataset: str, table: str | None, replace: bool) -> str:
        name = clean_name(dataset)
        taken = [row["dataset_name"] for row in self.catalog.table().filter(f"dataset_name = '{name}'").collect()]
        if taken and not replace:
            raise ValueError(f"Dataset exists: {name}")
        return f"{self.root}/tables/{clean_name(table or dataset)}-{uuid.uuid4().hex}"

    def _register(self, result: IngestResult, location: str) -> IngestResult:
        self.catalog.register(
            RegisteredDataset(
                result.dataset_name,
                result.table_name,
                result.source_path,
                result.row_count,
                location,
                created_at=result.created_at,
            )
        )
        return result

    def table(self, dataset: str) -> DataFrame:
        """The rows of a data set, also as a view under its dataset name."""
        entry = self.catalog.get(dataset)
        frame = self.spark.read.parquet(entry.location)
        frame.createOrReplaceTempView(entry.dataset_name)
        return frame

    def preview(self, dataset: str, limit: int = 20) -> Preview:
        return preview(self.table(dataset), limit)

    def profile(self, dataset: str, approx: bool = False) -> DatasetProfile:
        """Profile a data set and save the profile."""
        found = profile_dataset(dataset, self.table(dataset), approx)
        self.catalog.update(dataset, profile_path=store.write_profile(found, self.root))
        return found

    def build_model(self, dataset: str, business_context: str | None = None) -> SemanticModel:
        """Derive the metrics and dimensions of a data set and save them."""
        entry = self.catalog.get(dataset)
        frame = self.table(dataset)
        model = build_semantic_model(dataset, entry.table_name, role_profile(frame), business_context)
        return self.save_model(validate_model(frame, model))

    def save_model(self, model: SemanticModel) -> SemanticModel:
        path = store.write_model(self.spark, model, self.root)
        self.catalog.update(model.dataset_name, semantic_path=path)
        return model

    def model(self, dataset: str) -> SemanticModel | None:
        """The saved model, if there is one."""
        return store.read_model(self.spark, self.root, dataset) if self.catalog.get(dataset).semantic_path else None

    def explain_metric(self, dataset: str, metric: str) -> DataFrame:
        model = self.model(dataset)
        if model is None:
            raise ValueError(f"Dataset {dataset} has no semantic model")
        return explain_metric(self.table(dataset), model, metric)

    def analyse(self, dataset: str, question: str = "", mode: str = "executive_summary") -> AnalysisReport:
        """Run a report with the saved or a derived model, and save its evidence."""
        entry = self.catalog.get(dataset)
        report = run_analysis(
            dataset, self.table(dataset), question, mode, self.model(dataset), entry.table_name
        )
        return store.write_evidence(report, self.root)

    def hint(self, dataset: str, config: SemanticConfig | None = None) -> str:
        """What the first reply of a conversation says about a data set: preferred views, metrics, dimensions."""
        model = self.model(dataset)
        return semantic_hint(
            [metric.name for metric in model.metrics] if model else (),
            [item.name for item in model.dimensions] if model else (),
            config.preferred_views if config else (),
        )

    def converse(self, dataset: str, messages: DataFrame, config: SemanticConfig | None = None, **columns) -> DataFrame:
        """Classify messages about a data set and give the fixed replies; ``columns`` as in ``previous_queries``."""
        return previous_queries(messages, hint=self.hint(dataset, config), **columns)

    def ask(self, dataset: str, question: str, sql: str, config: SemanticConfig | None = None) -> Answer:
        """Answer a question by a SQL text over the data set, which it names by its dataset or table name.

        Tables that the settings forbid are refused, whatever they are called from.
        """
        entry = self.catalog.get(dataset)
        self.table(dataset).createOrReplaceTempView(entry.table_name)
        model = self.model(dataset)
        return answer(
            self.spark,
            question,
            sql,
            allowed_tables=[entry.dataset_name, entry.table_name],
            forbidden_tables=config.forbidden_tables if config else (),
            metric_names=[metric.name for metric in model.metrics] if model else (),
            dimension_names=[item.name for item in model.dimensions] if model else (),
        )
