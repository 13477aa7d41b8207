from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF_DIR, load
from pyspark.sql import functions as F

from tallyline.llm import grouping, packing
from tallyline.llm.queries import QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check_places(rows, limit) -> int:
    """Every sequence is filled from 0 without gaps and within the limit; the number of sequences."""
    by = defaultdict(list)
    for row in rows:
        by[row.sequence_id].append((row.offset, row.length))
    for parts in by.values():
        parts.sort()
        assert [offset for offset, _ in parts] == np.cumsum([0] + [size for _, size in parts[:-1]]).tolist()
        assert sum(size for _, size in parts) <= limit
    return len(by)


def test_query_agrees_with_plain_encoding(spark, plain):
    found = defaultdict(list)
    rows = QUERIES["op1_best_fit_packing"](spark, SF_DIR).collect()
    for row in rows:
        found[row.doc_id].append(row)
    docs = load(spark, "documents").select("doc_id", "text").collect()
    total = 0
    for doc in docs:
        ids = np.array([*plain.encode(doc.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        parts = sorted(found[doc.doc_id], key=lambda row: row.piece)
        assert [row.piece for row in parts] == list(range(-(-len(ids) // 1024)))
        assert [row.start for row in parts] == np.cumsum([0] + [row.length for row in parts[:-1]]).tolist()
        assert all(row.length == 1024 for row in parts[1:]) and sum(row.length for row in parts) == len(ids)
        assert all(row.ids_crc32 == zlib.crc32(ids[row.start : row.start + row.length].tobytes()) for row in parts)
        total += len(ids)
    assert len(found) == len(docs)
    assert check_places(rows, 1024) <= 1.02 * total / 1024 + 2


@pytest.mark.parametrize("shard", [50, 10_000])
def test_shards_and_rounds_keep_all_and_stay_near_the_bound(spark, shard):
    lengths = np.random.default_rng(3).integers(1, 101, 2000).tolist()
    frame = spark.createDataFrame([(n,) for n in lengths], "length long").repartition(3)
    rows = packing.pack(frame, limit=100, shard=shard, islands=3, epochs=3).select("row.length", "sequence_id", "offset").collect()
    assert sorted(row.length for row in rows) == sorted(lengths)
    assert check_places(rows, 100) <= sum(lengths) / 100 * (1.08 if shard == 50 else 1.03) + 1


def test_edges_of_the_input(spark, plain):
    texts = [None, "", "a" * 50_000, "word " * 3000, "same", "same"]
    rows = [(n if n != 3 else None, text, 5, "x") for n, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA + ", length int, place string")
    cut = packing.pieces(frame, tokenizer_path(), limit=64)
    packed = packing.pack(cut, limit=64, islands=1)
    whole = {bytes(r.ids) for r in packing.sequences(packed).collect()}
    found = defaultdict(bytes)
    for row in packed.select("row.row.doc_id", "row.piece", "row.ids", "row.length", "sequence_id", "offset").orderBy("piece").collect():
        found[row.doc_id] += bytes(row.ids)
        assert any(ids[4 * row.offset : 4 * (row.offset + row.length)] == bytes(row.ids) for ids in whole)
    for ident, text, *_ in rows:
        assert found[ident] == np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()


def test_a_very_long_text_is_packed(spark, plain):
    text = " ".join(f"word{n % 977} tail" for n in range(1_600_000))
    frame = spark.createDataFrame([(1, "x")], "doc_id long, text string").select("doc_id", F.lit(text).alias("text"), F.lit(7).alias("n"))
    assert len(text) > 20_000_000
    cut = packing.pieces(frame, tokenizer_path())
    assert cut.select("row.*").columns == ["doc_id", "n"]
    packed = packing.pack(cut.select("row.doc_id", "piece", "start", "length", F.crc32("ids").alias("sum")))
    rows = sorted(packed.select("row.*", "sequence_id", "offset").collect(), key=lambda row: row.piece)
    half = len(text) // 2
    cut_at = text.index(" ", half)
    ids = np.array([*plain.encode(text[:cut_at], add_special_tokens=False).ids, *plain.encode(text[cut_at:], add_special_tokens=False).ids, 2], dtype="<u4")
    assert [row.start for row in rows] == np.cumsum([0] + [row.length for row in rows[:-1]]).tolist()
    assert sum(row.length for row in rows) == len(ids) and len(rows) == -(-len(ids) // 1024)
    assert all(row.sum == zlib.crc32(ids[row.start : row.start + row.length].tobytes()) for row in rows)
    check_places(rows, 1024)


def test_a_table_of_texts_alone(spark):
    frame = spark.createDataFrame([("a b",), (None,), ("a b",)], "text string")
    assert packing.pack(packing.pieces(frame, tokenizer_path())).count() == 3


def test_lengths_that_fit_nowhere_get_no_sequence(spark):
    frame = spark.createDataFrame([(None,), (0,), (-3,), (11,), (10,), (4,)], "length long")
    rows = packing.pack(frame, limit=10).collect()
    assert sorted(row.row.length for row in rows if row.sequence_id is not None) == [4, 10]
    assert len(rows) == 6


def test_empty_table(spark):
    assert packing.pack(packing.pieces(spark.createDataFrame([], SCHEMA), tokenizer_path())).count() == 0


def test_evolution_never_loses_an_item_or_gets_worse():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 1024, 500))[::-1].astype(np.int64)
    population = grouping.start(lengths, 1024, 6, rng)
    before = max(grouping.fitness(lengths, own, 1024) for own in population)
    after = grouping.evolve(lengths, population, 1024, 40, rng)
    assert grouping.fitness(lengths, after[0], 1024) >= before
    for own in after:
        fill = np.bincount(own, weights=lengths)
        assert (own >= 0).all() and fill.max() <= 1024 and (fill > 0).all()


def test_crossing_comes_within_one_bin_of_a_perfect_packing():
    rng = np.random.default_rng(4)
    perfect = [[60, 40], [50, 30, 20], [70, 30], [55, 45], [25, 25, 50]] * 8
    lengths = np.sort(np.array([size for own in perfect for size in own]))[::-1].astype(np.int64)
    best = grouping.evolve(lengths, grouping.start(lengths, 100, 8, rng), 100, 200, rng)[0]
    assert best.max() + 1 <= len(perfect) + 1
