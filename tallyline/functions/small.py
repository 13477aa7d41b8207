"""Tables of a few rows that come from the driver, such as metric definitions and wordings."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A local relation, which the optimizer can evaluate without a job."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if not rows:
        empty = [F.lit(None).cast(field.dataType).alias(field.name) for field in fields]
        return spark.range(0).select(*empty)
    columns = {field.name: pa.array([row[i] for row in rows]) for i, field in enumerate(fields)}
    return spark.createDataFrame(pa.table(columns), schema=fields)
