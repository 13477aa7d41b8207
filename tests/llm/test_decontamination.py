from __future__ import annotations

import random
import re

import pytest

from tallyline.llm import decontamination

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def words_of(text):
    lower = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, span=10):
    windows = set()
    for ident, text in items:
        words = words_of(text)
        if words:
            size = min(span, len(words))
            windows |= {("" if ident is None else str(ident), tuple(words[i : i + size])) for i in range(len(words) - size + 1)}
    out = []
    for ident, text in docs:
        words, hit, names = words_of(text), set(), set()
        for name, run in windows:
            for i in range(len(words) - len(run) + 1):
                if tuple(words[i : i + len(run)]) == run:
                    hit.update(range(i, i + len(run)))
                    names.add(name)
        out.append((ident, len(words), len(hit), sorted(names)))
    return sorted(out, key=repr)


def ours(spark, docs, items, **options):
    frame = spark.createDataFrame([(*row, "clash", 1) for row in docs], DOCS + ", found string, n_words int")
    marked = decontamination.mark_benchmark(frame, spark.createDataFrame(items, ITEMS), **options)
    rows = marked.select("row.doc_id", "found.n_words", decontamination.hit_words(marked["found"]), "found.items").collect()
    return sorted((tuple(row) for row in rows), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "B", "é", "x1", "the"]
    make = lambda low, high: [rng.choice(words) for _ in range(rng.randint(low, high))]
    passages = [make(1, 30) for _ in range(8)]
    items = [(n, " ".join(passage)) for n, passage in enumerate(passages)]
    items += [(100, items[0][1]), (None, items[1][1].upper()), (101, None), (102, "..."), (3, items[3][1])]
    docs = []
    for n in range(60):
        text = make(0, 20)
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(passages)
            start = rng.randrange(len(part))
            text += part[start : start + rng.randint(1, 14)] + make(0, 5)
        docs.append((n % 50, rng.choice([" ", "-", "\n. "]).join(text)))
    return docs + [(None, None), (200, ""), (201, "the " * 3000), (None, items[0][1] * 2)], items


@pytest.mark.parametrize("options", [{}, {"block_bytes": 60}, {"gram": 1}, {"gram": 10}, {"gram": 2, "span": 4}, {"gram": 2, "span": 4, "block_bytes": 1}])
def test_small_corpora_agree_with_all_windows(spark, options):
    for seed in (1, 2):
        docs, items = corpus(seed)
        assert ours(spark, docs, items, **options) == brute(docs, items, options.get("span", 10))


def test_empty_tables(spark):
    docs, items = corpus(1)
    assert ours(spark, [], items) == []
    assert ours(spark, docs, []) == brute(docs, [])
    with pytest.raises(ValueError, match="gram"):
        ours(spark, docs, items, gram=11)


def test_repeated_items_are_fetched_once(spark):
    items = [(1, "a b c d e f g h i j k")] * 500 + [(2, "a b"), (None, None), (None, None)]
    distinct = decontamination.distinct_items(spark.createDataFrame(items, ITEMS).repartition(3), "item_id", "text")
    assert sorted(tuple(row) for row in distinct.collect()) == [("", ""), ("1", items[0][1]), ("2", "a b")]
    assert decontamination.small_index(distinct, 5, 10, 30) is None
    assert sorted(decontamination.small_index(distinct, 5, 10, 1000).names) == [["1"], ["2"]]


def test_a_gram_of_many_items_goes_by_the_join(spark, monkeypatch):
    """Items that share an instruction, in either plan, and a plan with one Python stage however large the benchmark."""
    told = "answer the question below in one short sentence please and thanks"
    items = [(n, f"{told} number{n} {' '.join(f'w{n}x{k}' for k in range(n % 7))}") for n in range(40)]
    docs = [(1, told), (2, items[3][1] + " end"), (3, "below in one short sentence please"), (4, items[3][1].upper())] * 3
    expected = brute(docs, items)
    assert ours(spark, docs, items) == expected
    monkeypatch.setattr(decontamination, "MOST_PLACES", 5)
    assert ours(spark, docs, items) == expected
    assert ours(spark, docs, items, filter_bits=64) == expected
    frame = decontamination.mark_benchmark(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_bytes=100)
    assert "MapInArrow" not in frame._jdf.queryExecution().executedPlan().toString()


def test_long_and_odd_texts_go_by_the_join(spark):
    passage = " ".join(f"é{n}" for n in range(30_000))
    items = [(1, passage), (1, "𝔘nd so"), (2, "x"), (None, "𝔘nd so"), (3, "")]
    docs = [(1, passage[50_000:90_000]), (2, "x " * 50_000), (3, "we 𝔘nd so, x"), (4, None), (5, "K\u0130x")]
    by_join = ours(spark, docs, items, block_bytes=1)
    assert by_join == ours(spark, docs, items)
    assert [row[2] > 0 for row in by_join] == [True, True, True, False, False]
    assert by_join[2] == (3, 4, 3, ["", "1", "2"])
    assert ours(spark, [], items, block_bytes=1) == []
