"""The pipeline against brute force, stage by stage and as a whole."""

from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF_DIR, load

from tallyline.llm import pipeline
from tallyline.llm.queries import tokenizer_path

from . import test_decontamination, test_line_dedup, test_near_dedup, test_quality_rules
from .test_packing import check_places

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def good(rows):
    kept = test_quality_rules.verdicts([(row["text"], row["lang"]) for row in rows])
    return [row for row, passed in zip(rows, kept, strict=True) if passed]


def cut(rows):
    kept = test_line_dedup.brute([(row["doc_id"], row["text"]) for row in rows])
    by = {ident: text for ident, _, _, text in kept}
    return [row | {"text": by[row["doc_id"]]} for row in rows]


def first(rows):
    parts = {ident: part for ident, _, part in test_near_dedup.brute([(row["doc_id"], row["text"]) for row in rows])}
    return [row for row in rows if parts[row["doc_id"]] == row["doc_id"]]


def clean(rows, items):
    hits = {ident: n for ident, _, n, _ in test_decontamination.brute([(r["doc_id"], r["text"]) for r in rows], items)}
    return [row for row in rows if not hits[row["doc_id"]]]


def test_run_agrees_with_brute_force(spark):
    from tokenizers import Tokenizer

    rows = [row.asDict() for row in load(spark, "documents").collect()]
    items = [tuple(row) for row in load(spark, "benchmark").select("item_id", "text").collect()]
    assert len({row["doc_id"] for row in rows}) == len(rows)
    kept = clean(first(cut(good(rows))), items)
    assert 20 < len(kept) < len(rows)
    plain, wanted = Tokenizer.from_file(tokenizer_path()), set()
    for row in kept:
        ids = np.array([*plain.encode(row["text"], add_special_tokens=False).ids, 2], dtype="<u4")
        start = 0
        for piece in range(-(-len(ids) // 1024)):
            size = (len(ids) - 1) % 1024 + 1 if piece == 0 else 1024
            wanted.add((row["doc_id"], piece, start, size, zlib.crc32(ids[start : start + size].tobytes())))
            start += size
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == wanted and len(found) == len(wanted)
    assert check_places(found, 1024) <= 1.05 * sum(row[3] for row in wanted) / 1024 + 2


def test_stages_keep_the_columns_and_their_types(spark):
    docs = load(spark, "documents").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).dtypes == docs.dtypes
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "near dedup", "decontamination", "packing"
    ]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, None, None, None, None), (None, "", "en", "s", 0), (1, None, None, None, None)]])
def test_nulls_repeats_and_empty_tables(spark, rows):
    extra = [(*row, 7, "x", 1.0) for row in rows]
    docs = spark.createDataFrame(extra, COLUMNS + ", found int, row string, fingerprint double")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.dtypes == docs.dtypes and out.count() == (1 if rows and stage is pipeline.keep_first else len(rows))
    assert pipeline.keep_good(spark, docs, SF_DIR).count() == 0
    assert pipeline.pack(spark, docs, SF_DIR).count() == len(rows)


def test_counts_follow_the_cut_text(spark):
    line = "one two three four five six"
    docs = spark.createDataFrame([(1, line, "en", "s", 27), (2, f"é\n{line}", "en", "s", 29)], COLUMNS)
    found = {row.doc_id: (row.text, row.n_chars) for row in pipeline.cut_lines(spark, docs, SF_DIR).collect()}
    assert found == {1: (line, 27), 2: ("é", 1)}
