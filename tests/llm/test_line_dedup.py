from __future__ import annotations

import random

import pytest

from tallyline.llm import line_dedup

SCHEMA = "doc_id long, text string"


def one_edit(a: tuple, b: tuple) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:n] + long[n + 1 :] == short for n in range(len(long)))


def brute(rows, min_words=5, equal_words=1):
    """Lines of fewer than ``min_words`` words go if an earlier line is equal, others also if one is near."""
    judged = [
        (ident, place, words)
        for ident, text in rows
        if ident is not None and text is not None
        for place, line in enumerate(text.split("\n"))
        if len(words := tuple(line.encode().lower().split())) >= equal_words
    ]
    first: dict[tuple, tuple] = {}
    for ident, place, words in judged:
        first[words] = min((ident, place), first.get(words, (ident, place)))
    long = [words for words in first if len(words) >= min_words]
    early = first | {words: min(first[other] for other in long if one_edit(words, other)) for words in long}
    gone = {(ident, place, words) for ident, place, words in judged if (ident, place) > early[words]}
    out = []
    for ident, text in rows:
        parts = [] if text is None else text.split("\n")
        kept = [line for place, line in enumerate(parts) if (ident, place, tuple(line.encode().lower().split())) not in gone]
        out.append((ident, len(parts), len(parts) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


def ours(frame, **options):
    found = line_dedup.remove_lines(frame, **options).select("row.doc_id", "found.n_lines", "found.removed", "found.kept")
    return sorted(((r.doc_id, r.n_lines, len(r.removed), r.kept) for r in found.collect()), key=repr)


def corpus(seed: int):
    rng = random.Random(seed)
    words = ["a", "b", "É", "The", "x\u0000", "d"]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 8))] for _ in range(12)]
    rows = []
    for _ in range(50):
        lines = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                place = rng.randrange(len(line))
                line[place : place + rng.randint(0, 1)] = rng.choice([[], [rng.choice(words)], ["new"]])
                line = line or ["z"]
            lines.append(rng.choice([" ", "  ", "\t"]).join(line))
        rows.append((rng.randint(0, 10_000), "\n".join(lines)))
    return rows + rows[:3] + [(None, rows[0][1]), (10_001, None), (10_002, ""), (None, None), (10_003, "a b c d e\r\nA B C D E\n\n" * 3)]


@pytest.mark.parametrize("bits", [1 << 20, 64])
def test_small_corpora_agree_with_all_pairs(spark, bits):
    for seed in (1, 2):
        rows = corpus(seed)
        frame = spark.createDataFrame([(*row, "clash", 1) for row in rows], SCHEMA + ", found string, place int").repartition(3)
        assert ours(frame, filter_bits=bits) == brute(rows)


def test_very_long_lines(spark):
    long = " ".join(f"w{n}" for n in range(4000))
    rows = [(1, long), (2, long.replace("w7 ", "")), (3, long.replace("w7 ", "v ")), (4, long.replace("w7 ", "v u "))]
    assert ours(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_table(spark):
    assert ours(spark.createDataFrame([], SCHEMA)) == []
    with pytest.raises(ValueError, match="fewer"):
        line_dedup.remove_lines(spark.createDataFrame([], SCHEMA), min_words=2)


def test_halves_of_near_lines_meet():
    rng = random.Random(3)
    for _ in range(3000):
        line = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(5, 9))]
        other = list(line)
        place = rng.randrange(len(line))
        other[place : place + rng.randint(0, 1)] = [[], [b"z"]][rng.randint(0, 1)]
        assert set(line_dedup.half_keys(line)) & set(line_dedup.half_keys(other))


@pytest.mark.parametrize("bits", [1 << 20, 64])
def test_short_lines_that_equal_an_earlier_one_go(spark, bits):
    rows = [*corpus(3), (20_000, "All rights reserved.\n\nles."), (20_001, "LES.\nall  rights reserved.\nall rights\n \n")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = ours(frame, filter_bits=bits)
    assert found == brute(rows)
    assert ours(frame, filter_bits=bits, equal_words=5) == brute(rows, equal_words=5) != found
    assert (20_001, 5, 2, "all rights\n \n") in found
    with pytest.raises(ValueError, match="equal_words"):
        line_dedup.remove_lines(frame, equal_words=6)
