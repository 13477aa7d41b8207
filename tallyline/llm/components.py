"""Connected components of an edge table, by joins.

Every round gives each node the smallest label among its neighbours and then follows labels of labels, so the number of
rounds grows with the logarithm of a component's diameter. Labels are written to the shared folder in each round. A node
with very many edges is no single task's work: minima are combined before the shuffle and joins can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for each node of the edges (``a``, ``b``); nulls and loops are ignored."""
    pairs = edges.where(F.col("a") != F.col("b")).select("a", "b")
    both = written(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("via")
        )
        after = labels.select(F.col("node").alias("via"), F.col("label").alias("jump"))
        step = written(lower.join(after, "via").select("node", "old", F.least("via", "jump").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
