"""What the operators share about frames: rows kept whole beside the results, tables written once, checked sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.session import scratch_path

ROW = "row"


def whole_rows(frame: DataFrame, keep: list[str] | None = None, **columns: str) -> DataFrame:
    """All columns of the frame, or the kept ones, in one struct ``row``, beside the named ones.

    Results can then never clash with a column of the input.
    """
    return frame.select(F.struct(*[F.col(f"`{name}`") for name in keep or frame.columns]).alias(ROW), *named(columns))


def named(columns: dict[str, str]) -> list:
    return [F.col(f"`{source}`").alias(target) for target, source in columns.items()]


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read again: its lineage ends there."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def joined(left: DataFrame, right: DataFrame, on, how: str, most: int, weight=None) -> DataFrame:
    """A join that broadcasts the right side only if its rows, or the sum of their ``weight``, are at most ``most``.

    The right side must be a written table, so that counting it costs little.
    """
    count = right.agg(F.sum(F.lit(1) if weight is None else weight + 1)).first()[0] or 0
    return left.join(F.broadcast(right) if count <= most else right.hint("merge"), on, how)
