"""A pipeline over ``documents``: quality rules, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyline.llm import pipeline

STAGES = [
    ("quality rules", pipeline.keep_good),
    ("line dedup", pipeline.cut_lines),
    ("near dedup", pipeline.keep_first),
    ("decontamination", pipeline.decontaminate),
    ("packing", pipeline.pack),
]
ORACLE_SQL = None  # tokenizing and similarity fingerprints are beyond SQL; tests compare run() with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run_stages(spark, sf_dir, STAGES)
