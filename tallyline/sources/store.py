"""Results on shared storage, read back with their schemas."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.models import FINDINGS_SCHEMA, SemanticConfig, SemanticModel
from tallyline.operators.profile import DatasetProfile
from tallyline.plans.report import AnalysisReport

NOTE_FILE_ROWS = 1_000_000
PROFILE_SCHEMA = (
    "dataset_name string, ordinal int, column string, data_type string, type_class string, row_count bigint, "
    "null_count bigint, distinct_count bigint, null_rate double, role string, min double, max double, mean double, "
    "median double, stddev double, top_values array<struct<value:string,count:bigint>>, "
    "date_min timestamp_ntz, date_max timestamp_ntz"
)


def _load(path: str, reader) -> DataFrame:
    try:
        return reader()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Nothing is saved at {path}") from error
        raise


def profile_path(root: str, dataset_name: str) -> str:
    return f"{root.rstrip('/')}/profiles/{dataset_name}"


def model_path(root: str, dataset_name: str) -> str:
    return f"{root.rstrip('/')}/semantics/{dataset_name}"


def evidence_path(root: str, dataset_name: str) -> str:
    return f"{root.rstrip('/')}/evidence/{dataset_name}_latest"


def ranked_path(root: str, dataset_name: str) -> str:
    return f"{root.rstrip('/')}/ranked/{dataset_name}_latest"


def write_profile(profile: DatasetProfile, root: str) -> str:
    path = profile_path(root, profile.dataset_name)
    profile.table().write.mode("overwrite").json(path)
    return path


def read_profile(spark: SparkSession, root: str, dataset_name: str) -> DataFrame:
    path = profile_path(root, dataset_name)
    return _load(path, lambda: spark.read.schema(PROFILE_SCHEMA).json(path))


def write_model(spark: SparkSession, model: SemanticModel, root: str) -> str:
    path = model_path(root, model.dataset_name)
    spark.createDataFrame([(json.dumps(model.to_dict()),)], "value string").write.mode("overwrite").text(path)
    return path


def read_model(spark: SparkSession, root: str, dataset_name: str) -> SemanticModel:
    path = model_path(root, dataset_name)
    saved = _load(path, lambda: spark.read.text(path, wholetext=True)).first()
    return SemanticModel.from_dict(json.loads(saved[0]))


def read_config(spark: SparkSession, path: str) -> SemanticConfig:
    """A hand-written configuration file, in JSON, or in YAML where a YAML reader is installed."""
    text = _load(path, lambda: spark.read.text(path, wholetext=True)).first()[0]
    if path.lower().endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("Reading YAML needs the yaml package; use JSON instead") from error
        return SemanticConfig.from_dict(yaml.safe_load(text) or {})
    return SemanticConfig.from_dict(json.loads(text))


def write_evidence(report: AnalysisReport, root: str) -> AnalysisReport:
    """Save the findings as the modules made them, then ranked; return the report over the saved findings.

    The analysis runs once, in the first write. Ranking and summary read what was written.
    """
    spark = report.findings.sparkSession
    path = evidence_path(root, report.dataset_name)
    report.findings.write.mode("overwrite").parquet(path)
    saved = replace(report, findings=read_evidence(spark, root, report.dataset_name))
    saved.ranked.write.mode("overwrite").parquet(ranked_path(root, report.dataset_name))
    return saved


def read_evidence(spark: SparkSession, root: str, dataset_name: str) -> DataFrame:
    path = evidence_path(root, dataset_name)
    return _load(path, lambda: spark.read.schema(FINDINGS_SCHEMA).parquet(path))


def write_note_table(notes: DataFrame, path: str, session: str = "session", file_rows: int = NOTE_FILE_ROWS) -> None:
    """Save notes for very many sessions: sorted Parquet files of at most ``file_rows`` turns, and an index of them.

    The files hold many sessions each, or a part of a large one, so that their number follows the turns and not the
    sessions. The index has each file's first and last session; ``read_note_table`` opens only files that can hold the one
    it wants.
    """
    order = ["file_name", session, "turn_no"]
    notes.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", file_rows).mode(
        "overwrite"
    ).parquet(f"{path}/notes")
    saved = notes.sparkSession.read.schema(notes.schema).parquet(f"{path}/notes")
    saved.groupBy(F.col("_metadata.file_name").alias("part")).agg(
        F.min("file_name").alias("first"), F.max("file_name").alias("last"), F.count(F.lit(1)).alias("turns")
    ).sort("first").write.mode("overwrite").parquet(f"{path}/index")


def read_note_table(spark: SparkSession, path: str, file_name: str) -> DataFrame:
    """The turns of one notes file, in order; none when there is no such file."""
    index = _load(path, lambda: spark.read.parquet(f"{path}/index"))
    parts = index.filter((F.col("first") <= file_name) & (F.col("last") >= file_name)).select("part").collect()
    if not parts:
        return spark.read.parquet(f"{path}/notes").limit(0)
    rows = spark.read.parquet(*[f"{path}/notes/{row['part']}" for row in parts])
    return rows.filter(F.col("file_name") == file_name).orderBy("turn_no")


def write_result(result: DataFrame, path: str) -> None:
    """Save a query result as JSON lines."""
    result.write.mode("overwrite").json(path)


def read_result(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return _load(path, lambda: spark.read.schema(schema).json(path))
