"""Files to tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyline.functions.text import clean_name

CSV_OPTIONS = {"header": True, "enforceSchema": False}


@dataclass(frozen=True)
class IngestResult:
    dataset_name: str
    table_name: str
    row_count: int
    schema: T.StructType
    created_at: datetime
    source_path: str


def ingest_csv(
    spark: SparkSession,
    path: str,
    table: str,
    replace: bool = False,
    dataset: str | None = None,
    schema: T.StructType | str | None = None,
    location: str | None = None,
) -> IngestResult:
    """Load CSV files with a header into a table. Without a schema the types are inferred by one more read."""
    if schema is None:
        frame = _read(path, lambda: spark.read.options(header=True, inferSchema=True).csv(path))
    else:
        frame = _read(path, lambda: spark.read.options(**CSV_OPTIONS).schema(schema).csv(path))
    return _save(frame, path, table, replace, dataset, location)


def ingest_parquet(
    spark: SparkSession,
    path: str,
    table: str,
    replace: bool = False,
    dataset: str | None = None,
    location: str | None = None,
) -> IngestResult:
    """Load Parquet files into a table."""
    return _save(_read(path, lambda: spark.read.parquet(path)), path, table, replace, dataset, location)


def _read(path: str, reader) -> DataFrame:
    try:
        return reader()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"No such file or folder: {path}") from error
        raise


def _save(
    frame: DataFrame, path: str, table: str, replace: bool, dataset: str | None, location: str | None
) -> IngestResult:
    spark = frame.sparkSession
    table_name = clean_name(table)
    dataset_name = clean_name(dataset or table)
    if replace:
        spark.catalog.dropTempView(dataset_name)
    writer = frame.write.format("parquet").mode("overwrite" if replace else "errorifexists")
    if location is not None:
        writer = writer.option("path", location)
    writer.saveAsTable(table_name)
    saved = spark.table(table_name)
    if dataset_name != table_name:
        saved.createOrReplaceTempView(dataset_name)
    return IngestResult(
        dataset_name, table_name, saved.count(), saved.schema, datetime.now(tz=timezone.utc), path
    )
