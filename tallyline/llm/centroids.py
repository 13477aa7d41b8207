"""Clusters of vectors around integer centroids, by JVM-native expressions on arrays.

A vector's components become integers, ``floor(scale * x)``. Each round computes the squared distance of every vector to
each centroid, a literal array, with ``zip_with`` and ``aggregate``; ``array_min`` over structs of distance and number
chooses the nearest, the smaller number on ties. One aggregation sums the components of each cluster as plain columns, and
the floor of sum by count is the new centroid. A cluster without vectors keeps its centroid.

Only sums of clusters reach the driver: as many rows as centroids. No row is dealt by its cluster, so a cluster may hold
all vectors.

Vectors that are null, have another number of components, or hold null or non-finite entries are left out. Integers beyond
``LARGEST`` count as that, so that no distance leaves the range of a long; these are components beyond 2 million for a
scale of 64. Rows without an id come last among the starts; rows that repeat one are told apart by their vectors. With
fewer vectors than centroids each vector starts one, and without vectors the result is empty.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import ROW, whole_rows, written

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
LARGEST = 1 << 27


def finite(vector: Column, dimensions: int) -> Column:
    """Whether a vector has this many components, all finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) == dimensions) & ~F.exists(vector, bad), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    most = float(LARGEST)
    whole = lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x.cast("double") * scale).cast("double")))
    return F.transform(vector, lambda x: whole(x).cast("long"))


def nearest(vector: str, centroids: list[list[int]]) -> Column:
    """``distance`` and ``cluster`` of the nearest centroid. One text makes the expression, since each call that builds a part
    of it on the driver would cost more than many rows do."""
    literal = ", ".join(f"array({', '.join(f'{value}L' for value in centroid)})" for centroid in centroids)
    squares = f"zip_with({vector}, centroid, (a, b) -> (a - b) * (a - b))"
    distance = f"aggregate({squares}, 0L, (total, square) -> total + square)"
    return F.expr(f"array_min(transform(array({literal}), (centroid, n) -> named_struct('distance', {distance}, 'cluster', n)))")


def starts(kept: DataFrame, clusters: int, seed: str) -> list[list[int]]:
    """The vectors with the smallest hashes of ``seed`` and their id."""
    key = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    first = kept.select("vector", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "vector").limit(clusters)
    return [list(row.vector) for row in first.orderBy(F.col("key").asc_nulls_last(), "vector").collect()]


def moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floors of the clusters' means."""
    dimensions = len(centroids[0])
    sums = [F.expr(f"sum(vector[{place}]) AS s{place}") for place in range(dimensions)]
    assigned = kept.select("vector", nearest("vector", centroids)["cluster"].alias("cluster"))
    new = list(centroids)
    for row in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        new[row["cluster"]] = [row[f"s{place}"] // row["n"] for place in range(dimensions)]
    return new


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: str = "1:",
    keep: list[str] | None = None,
) -> tuple[DataFrame, list[list[int]]]:
    """Each remaining row as ``row`` beside its ``cluster`` and ``distance``, its cluster's and the whole ``inertia``, and the
    hash of its cluster's final centroid; and the final centroids."""
    frame = whole_rows(vectors, keep, id=vec_id, given=vector).where(finite(F.col("given"), dimensions))
    kept = written(frame.select(ROW, "id", integers(F.col("given"), scale).alias("vector")), "integers")
    centroids = starts(kept, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids)
    best = nearest("vector", centroids or [[0] * dimensions])
    assigned = written(kept.select(ROW, best.alias("best")).select(ROW, "best.*"), "assigned")
    inertia = {row["cluster"]: row["s"] for row in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    of_cluster = F.array(*[F.lit(inertia.get(number, 0)).cast("long") for number in range(max(1, len(centroids)))])
    hashes = F.array(*[F.lit(digest(centroid)) for centroid in centroids or [[]]])
    found = assigned.select(
        ROW,
        "cluster",
        "distance",
        F.get(of_cluster, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.get(hashes, F.col("cluster")).alias("centroid_sha256"),
    )
    return found, centroids
