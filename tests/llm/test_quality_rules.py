from __future__ import annotations

import math
import re
from collections import defaultdict

from conftest import SF_DIR, load

from tallyline.llm import quality_rules as rules
from tallyline.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string"


def base(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    starts = defaultdict(list)
    for i in range(len(words) - 2):
        starts[tuple(words[i : i + 3])].append(i)
    covered = {i + k for places in starts.values() if len(places) > 1 for i in places for k in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def kind(c: str) -> int:
    if c.isdigit() and c.isascii():
        return 2
    if c in " \t\n\v\f\r":
        return 3
    if c in ".,;:!?'\"()-":
        return 4
    if c in "#*$%&|<>":
        return 5
    return (1 if c.isupper() else 0) if c.isalpha() else 6


def described(text: str | None, lang: str | None) -> tuple:
    text = text or ""
    classes = common = None
    if len(text) >= rules.MIN_CHARS:
        classes = [sum(kind(c) == k for c in text) / len(text) for k in range(7)]
    if lang in rules.COMMON_WORDS:
        number = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        if number >= rules.MIN_COMMON_WORDS:
            words = text.lower().translate(dict.fromkeys(map(ord, rules.MARKS), " ")).split(" ")
            counts = [words.count(w) for w in rules.COMMON_WORDS[lang]]
            counts.append(max(0, number - sum(counts)))
            common = [count / sum(counts) for count in counts]
    return classes, common


def js(p, q):
    if p is None:
        return None
    part = lambda a, m: a * math.log2(a / m) if a > 0 else 0
    return math.sqrt(max(0, sum((part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2 for a, b in zip(p, q, strict=True))))


def mean(rows):
    return [sum(col) / len(col) for col in zip(*rows, strict=True)] if rows else None


def distances(rows):
    """Both distances of each (text, lang)."""
    groups, shapes = defaultdict(lambda: ([], [])), [described(*row) for row in rows]
    for (_, lang), both in zip(rows, shapes, strict=True):
        for place in (0, 1):
            if both[place]:
                groups[lang][place].append(both[place])
    known = {lang: tuple(map(mean, both)) for lang, both in groups.items()}
    return [
        tuple(js(both[k], known.get(lang, (None, None))[k]) for k in (0, 1))
        for (_, lang), both in zip(rows, shapes, strict=True)
    ]


def verdicts(rows):
    limits = (rules.MOST_CLASS_DISTANCE, rules.MOST_WORD_DISTANCE)
    return [
        not base(text)[-1] and all((d or 0) <= most for d, most in zip(both, limits, strict=True))
        for (text, _), both in zip(rows, distances(rows), strict=True)
    ]


def test_query_agrees_with_plain_python(spark):
    rows = load(spark, "documents").select("doc_id", "text", "lang").collect()
    found = {row.doc_id: row for row in QUERIES["op6_quality_rules"](spark, SF_DIR).collect()}
    judged = rules.judge(load(spark, "documents"))
    measured = {r.doc_id: r for r in judged.select("row.doc_id", "class_distance", "word_distance").collect()}
    plain = [(row.text, row.lang) for row in rows]
    for row, expected, kept in zip(rows, distances(plain), verdicts(plain), strict=True):
        one, got = found[row.doc_id], measured[row.doc_id]
        counts = (one.n_words, one.word_chars, one.n_symbols, one.n_dup_lines, one.n_repeat_words, one.base_failed)
        assert counts == base(row.text) and one.kept == kept
        for mine, theirs in zip(expected, (got.class_distance, got.word_distance), strict=True):
            assert (mine is None) == (theirs is None) and (mine is None or abs(mine - theirs) < 1e-6)


def test_edges_of_the_input(spark):
    plain = "the cat of my aunt sat and then it was with us " * 3
    rows = [
        (1, None, "en"),
        (2, "", None),
        (None, "a b c a b c a", "xx"),
        (4, "\n\n x\n x\nx\n \n", "en"),
        (5, "É<b>　\x1c\x00 " * 4000, "fr"),
        (5, "É<b>　\x1c\x00 " * 4000, "fr"),
        (6, plain, None),
    ]
    frame = spark.createDataFrame([(*row, 1, "x") for row in rows], SCHEMA + ", words int, kept string")
    found = rules.judge(frame).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr((i, *base(text))) for i, text, _ in rows)


def test_empty_table(spark):
    assert rules.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    documents = load(spark, "documents")
    for frame in (rules.judge(documents), rules.described(documents, None, "lang", "text", 600, 120)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
