from __future__ import annotations

import hashlib
import math

import pytest

from tallyline.llm import centroids
from tallyline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, clusters, rounds=3):
    kept = [(ident, [math.floor(64 * x) for x in vector]) for ident, vector in rows]
    start = sorted(kept, key=lambda row: (row[0] is None, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest(), row[1]))
    centres = [vector for _, vector in start[:clusters]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda vector: min((distance(vector, centre), n) for n, centre in enumerate(centres))
    for _ in range(rounds):
        of = [[vector for _, vector in kept if nearest(vector)[1] == n] for n in range(len(centres))]
        centres = [[sum(c) // len(own) for c in zip(*own, strict=True)] if own else old for own, old in zip(of, centres, strict=True)]
    found = [(ident, *nearest(vector)) for ident, vector in kept]
    inertia = [sum(d for _, d, n in found if n == number) for number in range(len(centres))]
    hashes = [hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest() for centre in centres]
    return sorted(((i, n, d, inertia[n], sum(inertia), hashes[n]) for i, d, n in found), key=repr)


def ours(frame, **options):
    found, _ = centroids.cluster(frame, **options)
    names = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(row) for row in found.select("row.vec_id", *names).collect()), key=repr)


def test_small_tables_agree_with_plain_integers(spark):
    import random

    rng = random.Random(4)
    rows = [(n, [rng.choice([-1.5, 0.0, 0.013, 2.0]) for _ in range(3)]) for n in range(80)] + [(None, [0.5] * 3), (7, [9.0] * 3), (7, [9.0] * 3)]
    nan, inf = float("nan"), float("inf")
    bad = [(90, None), (91, []), (92, [0.0] * 4), (93, [nan, 0.0, 0.0]), (94, [0.0, -inf, 0.0]), (95, [None, 0.0, 0.0])]
    frame = spark.createDataFrame([(*row, 1, "x") for row in rows + bad], SCHEMA + ", cluster int, row string").repartition(3)
    assert ours(frame, dimensions=3, clusters=5) == brute(rows, 5)


def test_empty_clusters_keep_their_centroids(spark):
    rows = [(n, [1.0, 1.0]) for n in range(6)]
    found = ours(spark.createDataFrame(rows, SCHEMA), dimensions=2, clusters=4)
    assert found == brute(rows, 4) and {row[1] for row in found} == {0}


def test_fewer_vectors_than_centroids_and_huge_entries(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 0.0])]
    found = ours(spark.createDataFrame(rows, SCHEMA), dimensions=2, clusters=16)
    assert [row[2] for row in found] == [0, 0]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0])]])
def test_tables_without_vectors(spark, rows):
    found, centres = centroids.cluster(spark.createDataFrame(rows, SCHEMA))
    assert found.count() == 0 and centres == []


def test_no_python_worker_in_the_plan(spark):
    found = QUERIES["op13_centroid_clustering"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
