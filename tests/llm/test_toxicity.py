from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from conftest import load

from tallyline.llm import toxicity
from tallyline.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string"
PLAIN = "you are an idiot and a clown but the list of items is in the text so this is a test of some stupid moron " * 30


@pytest.fixture(scope="module")
def language():
    numbers = np.concatenate([[0, 0], toxicity.symbols(PLAIN)])
    codes, counts = np.unique(toxicity.trigram_codes(numbers), return_counts=True)
    return toxicity.Language.of(codes, counts)


def test_held_out_documents_are_told_apart(spark):
    found = {row.doc_id: row for row in QUERIES["op12_toxicity"](spark, SF).collect()}
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0) for row in found.values())
    assert all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.5) for row in found.values())
    labels = [row for row in spark.read.parquet(f"{SF}/labels.parquet").collect() if found[row.doc_id].held_out]
    assert np.mean([found[row.doc_id].predicted == row.toxic for row in labels]) >= 0.97
    assert np.mean([found[row.doc_id].predicted for row in labels if row.toxic]) >= 0.8
    assert np.mean([found[row.doc_id].predicted for row in labels if not row.toxic]) <= 0.01


def all_paths(text, language):
    """The cheapest of all ways through the lattice, tried one by one."""
    best = (float("inf"), "")
    for way in itertools.product(*[own for own in toxicity.arcs(text) if own]):
        x = y = 0
        total, letters, fine = 0.0, "", True
        for letter, price in way:
            total += price
            if letter == " ":
                fine = fine and y > 0
                total, x, y = total + float(language.cost[x, y, 0]), 0, 0
            elif letter:
                z = toxicity.number(letter)
                total, x, y = total + float(language.cost[x, y, z]), y, z
            letters += letter
        if fine:
            best = min(best, (total + (float(language.cost[x, y, 0]) if y else 0.0), letters))
    return best[1]


@pytest.mark.parametrize("text", ["1d10t", "i.d.i.o.t", "iidiioot", "cl0wwn", "$tup1d", "th3-l1st", "m0r0n!", "a1", "8", "is.the", "ééa1"])
def test_decoding_finds_the_cheapest_of_all_paths(language, text):
    assert toxicity.decode(text, language) == all_paths(text, language)


@pytest.mark.parametrize(
    ("text", "word"),
    [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooooot!!", "idiot"), ("(cl0wn),", "clown"), ("$tup1d", "stupid"), ("m*o*r*o*n", "moron")],
)
def test_disguised_words_are_restored(language, text, word):
    assert word in toxicity.token_words(text, language)


def test_spaced_words_are_restored(language):
    found = toxicity.spaced_words("what a i d i o t you are".split(), language)
    assert any(word.endswith("idiot") for word in found)
    long = list("idiot" * 40)
    assert "".join(toxicity.pieces("".join(long))) and any("idiot" in word for word in toxicity.spaced_words(long, language))
    assert toxicity.spaced_words("a b cd".split(), language) == set()


def test_every_word_of_half_a_piece_lies_in_one_whole():
    text = "".join(chr(97 + n % 26) for n in range(1000))
    found = list(toxicity.pieces(text))
    assert all(any(text[at : at + 32] in piece for piece in found) for at in range(len(text) - 32))


def test_trigrams_are_counted_whole_over_blocks(spark, monkeypatch):
    texts = ["abc  é Ab", None, "", "x1yz", "中文 a"]
    frame = spark.createDataFrame([(n, text) for n, text in enumerate(texts)], SCHEMA)
    numbers = toxicity.symbols("".join(f"{text}\n" for text in texts if text))
    codes, counts = np.unique(toxicity.trigram_codes(np.concatenate([[0, 0], numbers])), return_counts=True)
    wanted = toxicity.Language.of(codes, counts).cost
    assert np.allclose(toxicity.learn_language(frame, "text").cost, wanted)


def test_disguise_does_not_hide_what_was_learnt(spark):
    clean = ["the list of items is in the text", "this is a test", "you are so kind"]
    rows = [(n, clean[n % 3] + (" idiot" if n % 5 == 0 else "")) for n in range(200)]
    asked = [(1000, "you are an 1d10t"), (1001, "such a i d i o t here"), (1002, "IDIOOOT"), (1003, "kind items"), (1004, ""), (1005, None), (None, "idiot")]
    documents = spark.createDataFrame([(*row, 1, "x", 0.5) for row in rows + asked], SCHEMA + ", score int, row string, best double")
    labels = spark.createDataFrame([(n, int(n % 5 == 0)) for n in range(200)] + [(None, 1), (7, None), (5000, 1)], "doc_id long, toxic int")
    found = {row.row.doc_id: row.score for row in toxicity.score(documents, labels).collect()}
    assert all(found[n] > 0.9 for n in (1000, 1001, 1002, None)) and all(found[n] < 0.1 for n in (1003, 1004, 1005))


@pytest.mark.parametrize("labelled", [[], [(77, 0)], [(1, 1)], [(1, 1), (1, 1), (None, 0), (2, None)]])
def test_edges_of_the_input(spark, labelled):
    rows = [(1, "good text"), (1, "good text"), (2, None), (None, ""), (4, "z1" * 100_000), (5, "a " * 100_000), (6, "word " * 40_000)]
    documents = spark.createDataFrame([(*row, 1, "x") for row in rows], SCHEMA + ", score int, row string")
    found = toxicity.score(documents, spark.createDataFrame(labelled, "doc_id long, toxic int")).collect()
    assert len(found) == len(rows) and all(0 <= row.score <= 1 for row in found)


def test_steps_rise():
    steps = toxicity.monotonous([(0.0, 1, 10), (0.2, 5, 10), (0.4, 3, 10), (0.6, 3, 10), (0.8, 10, 10)])
    assert steps == [(0.0, 0.1), (0.2, 11 / 30), (0.8, 1.0)]


def test_empty_table(spark):
    assert toxicity.score(spark.createDataFrame([], SCHEMA), load(spark, "labels")).count() == 0
