from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyline.llm import substring_dedup

SCHEMA = "doc_id long, text string"


def brute(rows, window):
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()) for _, text in rows]
    least: dict[tuple, int] = {}
    for (ident, _), words in zip(rows, split, strict=True):
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if ident is not None:
                least[run] = min(ident, least.get(run, ident))
    out = []
    for (ident, _), words in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if ident is not None and least[tuple(words[i : i + window])] < ident:
                gone.update(range(i, i + window))
        out.append((ident, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=repr)


def ours(frame, **options):
    found = substring_dedup.remove_repeats(frame, **options).select(
        "row.doc_id",
        "found.n_words",
        F.aggregate("found.spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["begin"]),
        "found.kept",
    )
    return sorted((tuple(row) for row in found.collect()), key=repr)


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(40)] + ["É", "a\u0000b"]
    passages = [[rng.choice(words) for _ in range(rng.randint(6, 40))] for _ in range(5)]
    rows = []
    for ident in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 30))]
        rows.append((rng.randint(0, 80), rng.choice([" ", "\n", " \t "]).join(text)))
    return rows + rows[:5] + [(None, rows[0][1]), (3, None), (4, ""), (99, " x" * 2000), (100, "x " * 1500), (None, None)]


@pytest.mark.parametrize(("crowd", "bits"), [(2000, 1 << 16), (1, 1 << 16), (0, 64)])
def test_small_corpora_agree_with_all_windows(spark, crowd, bits):
    for seed in (1, 2):
        rows = corpus(seed)
        frame = spark.createDataFrame([(*row, "clash") for row in rows], SCHEMA + ", spans string").repartition(3)
        assert ours(frame, window=7, gram=3, crowd=crowd, filter_bits=bits) == brute(rows, 7)


def test_long_runs_are_cut(spark):
    rows = [(1, "a b " * 900), (2, "z " + "a b " * 700 + "c"), (3, "b a " * 50)]
    assert ours(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 50)


def test_empty_table(spark):
    assert ours(spark.createDataFrame([], SCHEMA)) == []


def test_hash_clashes_are_sorted_by_words():
    import numpy as np

    values = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], dtype=np.uint64)
    first = np.array([0, 3, 6])
    real = substring_dedup.W.grams
    try:
        substring_dedup.W.grams = lambda own, size: np.zeros(len(own), dtype=np.uint64)
        found = substring_dedup.sorted_classes(values, first, 3)
    finally:
        substring_dedup.W.grams = real
    assert found[0] == found[2] != found[1]


def test_digest_of_the_query(spark):
    from conftest import SF_DIR, load

    from tallyline.llm.queries import QUERIES

    rows = [tuple(r) for r in load(spark, "documents").select("doc_id", "text").collect()]
    wanted = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows, 50)]
    found = QUERIES["op8_substring_dedup"](spark, SF_DIR).collect()
    assert sorted((tuple(r) for r in found), key=repr) == sorted(wanted, key=repr)
