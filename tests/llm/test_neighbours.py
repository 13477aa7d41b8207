from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import load

from tallyline.llm import neighbours
from tallyline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_documents_are_told_apart(spark):
    found = {row.doc_id: row for row in QUERIES["op9_quality_neighbours"](spark, SF).collect()}
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1) for row in found.values())
    assert all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.5) for row in found.values())
    labels = [row for row in spark.read.parquet(f"{SF}/labels.parquet").collect() if found[row.doc_id].held_out]
    right = [found[row.doc_id].predicted == row.quality for row in labels]
    assert np.mean(right) >= 0.95
    bad = [found[row.doc_id].predicted == 0 for row in labels if row.quality == 0]
    assert np.mean(bad) >= 0.8


def test_scores_are_exact_votes():
    rng = np.random.default_rng(2)
    rows, labels = rng.random((60, neighbours.WIDTH), dtype=np.float32), rng.integers(0, 2, 60).astype(float)
    space = neighbours.learn(rows, labels, 8)
    asked = rng.random((7, neighbours.WIDTH), dtype=np.float32)
    points = asked @ space.directions
    for point, score in zip(points, space.scores(asked, 5, 2), strict=True):
        near = sorted(((float(point @ v / np.linalg.norm(point)), y) for v, y in zip(space.vectors, labels, strict=True)), reverse=True)[:5]
        assert score == pytest.approx(sum(w**2 * y for w, y in near) / sum(w**2 for w, _ in near), abs=1e-4)


def test_descriptions_do_not_run_across_texts():
    alone = [neighbours.described(pa.array([text])) for text in ("ab cd cd", "", "É|", None, "x")]
    together = neighbours.described(pa.array(["ab cd cd", "", "É|", None, "x"]))
    assert np.allclose(np.vstack(alone), together)
    assert together.shape[1] == neighbours.WIDTH


@pytest.mark.parametrize("labelled", [[], [(1, 1), (None, 0), (2, None), (77, 0), (1, 1)]])
def test_edges_of_the_input(spark, labelled):
    rows = [(1, "good text here", 1, "x"), (1, "good text here", 1, "x"), (2, None, 1, "x"), (None, "", 1, "x"), (4, "z" * 200_000, 1, "x")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, score int, row string")
    found = neighbours.score(documents, spark.createDataFrame(labelled, "doc_id long, quality int")).collect()
    assert len(found) == 5 and {row.score for row in found} == {1.0 if labelled else 0.5}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neighbours.score(empty, load(spark, "labels")).count() == 0
