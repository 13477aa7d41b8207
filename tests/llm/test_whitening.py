from __future__ import annotations

import numpy as np
import pytest
from conftest import SF_DIR, load

from tallyline.llm import whitening
from tallyline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows):
    """Plain integers and one dense eigenproblem over rows of (id, vector)."""
    x = [[int(np.floor(64 * float(np.float64(c)))) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(row[j] for row in x) for j in range(d)]
    off = [[n * row[j] - sums[j] for j in range(d)] for row in x]
    covariance = np.array([[sum(o[j] * o[k] for o in off) / n**3 for k in range(d)] for j in range(d)])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:32]
    values, vectors = np.abs(values[order]), vectors[:, order]
    white = np.array(off, dtype=np.float64) / n @ vectors / np.sqrt(values)
    return [sum(v * v for v in o) for o in off], white, values / np.trace(covariance)


def test_query_agrees_with_plain_integers(spark):
    rows = [(r.vec_id, r.embedding) for r in load(spark, "embeddings").orderBy("vec_id").collect()]
    deviation, white, explained = brute(rows)
    found = QUERIES["op11_embedding_whitening"](spark, SF_DIR).collect()
    place = {ident: n for n, (ident, _) in enumerate(rows)}
    assert len(found) == 32 * len(rows) and {row.n for row in found} == {len(rows)}
    ours = np.zeros((len(rows), 32))
    for row in found:
        at = place[row.vec_id]
        assert row.deviation == deviation[at] and row.explained == pytest.approx(explained[row.component - 1], rel=1e-9)
        ours[at, row.component - 1] = row.whitened
    signs = np.sign((ours * white).sum(axis=0))
    assert np.abs(ours * signs - white).max() < 1e-7
    assert np.abs(ours.T @ ours / len(rows) - np.eye(32)).max() < 1e-7
    assert {row.identity_error for row in found} == {found[0].identity_error} and found[0].identity_error < 1e-9


@pytest.mark.parametrize("reach", [1, 100, 1 << 40, 1 << 62])
def test_bit_slices_give_exact_products(reach):
    rng = np.random.default_rng(reach % 97)
    values = rng.integers(-reach, reach + 1, (131, 5))
    values[:, 3] = values[0, 3]
    sums, cross = whitening.products(values)
    plain = values.astype(object)
    assert (sums == plain.sum(axis=0)).all() and (cross == plain.T.dot(plain)).all()
    for value in (int(v) for v in cross.reshape(-1)):
        assert sum(part << 32 * n for n, part in enumerate(whitening.limbs(value))) == value


def test_edges_of_the_input(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0, -2.0]), (1, [0.5, 1.0, -2.0]), (None, [0.0, 3.0, 0.1]), (4, [-7.0, 0.2, 0.3])]
    bad = [(5, None), (6, []), (7, [nan, 0.0, 0.0]), (8, [0.0, inf, 0.0]), (9, [None, 0.0, 0.0]), (10, [1.0, 2.0])]
    frame = spark.createDataFrame([(*row, 3, "x") for row in good + bad], SCHEMA + ", n int, row string").repartition(3)
    model = whitening.fit(frame)
    rows = whitening.by_component(whitening.transform(frame, model), model).collect()
    deviation, _, explained = brute(good)
    assert model.n == 4 and len(rows) == 4 * len(model.eigenvalues) and len(model.eigenvalues) == 2
    assert sorted(row.deviation for row in rows if row.component == 1) == sorted(deviation)
    assert [row.explained for row in rows if row.row.vec_id == 4] == pytest.approx(explained[:2].tolist())
    assert rows[0].row.n == 3 and rows[0].row.row == "x"


def test_huge_entries_and_sums_beyond_a_long(spark):
    frame = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], SCHEMA)
    model = whitening.fit(frame)
    rows = whitening.transform(frame, model).collect()
    assert len(rows) == 3 and {row.deviation for row in rows if row.row.vec_id < 3} == {None}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_tables_without_spread_give_no_rows(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    model = whitening.fit(frame)
    assert whitening.by_component(whitening.transform(frame, model), model).count() == 0
