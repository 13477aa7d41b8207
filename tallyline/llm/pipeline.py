"""The stages of the corpus pipeline, each of which calls one operator.

All but the last keep the columns of the documents; extra columns go along. Rows with null texts or ids are handled as the
operators say; empty inputs give empty outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import decontamination, line_dedup, near_dedup, quality_rules
from tallyline.llm.frames import written
from tallyline.llm.queries import packed_documents

Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.judge(docs).where("kept").select("row.*")


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; ``n_chars`` follows the text. Emptied documents stay."""
    found = F.col("found")
    changed = F.size(found["removed"]) > 0
    row = F.col("row").withField("text", found["kept"])
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(changed, F.length(found["kept"]).cast(kind)).otherwise(F.col("row")["n_chars"]))
    return line_dedup.remove_lines(docs).select(row.alias("row")).select("row.*")


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id."""
    return near_dedup.group(docs).where("first").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    marked = decontamination.mark_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(F.size(F.col("found")["spans"]) == 0).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences."""
    return packed_documents(docs)


def run_stages(spark: SparkSession, sf_dir: str, stages: list[Stage]) -> DataFrame:
    """The stages one after the other, from ``documents``; each result is written and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(stages, start=1):
        docs = stage(spark, docs, sf_dir)
        if number < len(stages):
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs
