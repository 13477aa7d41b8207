from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_DIR, load

from tallyline.llm import kneser_ney
from tallyline.llm.queries import QUERIES


def tokens_of(text):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", raw), None]


class Brute:
    """The same model from dictionaries."""

    def __init__(self, texts):
        split = [tokens_of(text) for text in texts]
        self.counts = Counter(token for tokens in split for token in tokens)
        self.total = sum(self.counts.values())
        self.pairs = Counter(pair for tokens in split for pair in zip([b"<s> ", *tokens], tokens, strict=False))
        self.after, self.before = defaultdict(list), Counter()
        for (context, word), n in self.pairs.items():
            self.after[context].append(n)
            self.before[word] += 1
        self.d2 = self.discount(self.pairs.values())
        self.d1 = self.discount(self.before.values())
        self.rest = sum(self.d1[min(n, 3) - 1] for n in self.before.values()) / max(len(self.pairs), 1) if self.pairs else 1.0

    @staticmethod
    def discount(counts):
        t = [sum(c == n for c in counts) for n in (1, 2, 3, 4)]
        if not all(t[:3]):
            return kneser_ney.FALLBACK
        y = t[0] / (t[0] + 2 * t[1])
        d = (1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2])
        return d if all(0 < own < most for own, most in zip(d, (1, 2, 3), strict=True)) else kneser_ney.FALLBACK

    def lower(self, word):
        n = self.before[word]
        own = max(n - self.d1[min(n, 3) - 1], 0) / len(self.pairs) if n else 0
        return own + self.rest / (len(self.counts) + 1)

    def probability(self, context, word):
        after = self.after.get(context)
        if not after:
            return self.lower(word)
        n = self.pairs[context, word]
        own = max(n - self.d2[min(n, 3) - 1], 0) if n else 0
        return (own + sum(self.d2[min(c, 3) - 1] for c in after) * self.lower(word)) / sum(after)

    def score(self, text):
        tokens = tokens_of(text)
        whole = sum(math.log10(self.probability(*pair)) for pair in zip([b"<s> ", *tokens], tokens, strict=False))
        base = sum(math.log10((self.counts[t] + 0.1) / (self.total + 0.1 * (len(self.counts) + 1))) for t in tokens)
        return len(tokens), sum(self.counts[t] > 0 for t in tokens), base, whole


def test_query_agrees_with_dictionaries(spark):
    rows = load(spark, "documents").select("doc_id", "text").collect()
    out = {row.doc_id: zlib.crc32(str(row.doc_id).encode()) % 10 == 0 for row in rows}
    brute = Brute([row.text for row in rows if not out[row.doc_id]])
    found = {row.doc_id: row for row in QUERIES["op5_kneser_ney"](spark, SF_DIR).collect()}
    assert len(found) == len(rows)
    gain = 0
    for row in rows:
        one = found[row.doc_id]
        n_tokens, n_known, base, whole = brute.score(row.text)
        assert (one.held_out, one.n_tokens, one.n_known, one.train_tokens) == (out[row.doc_id], n_tokens, n_known, brute.total)
        assert one.base_score == pytest.approx(base, rel=1e-9) and one.score == pytest.approx(whole, rel=1e-9)
        gain += (one.score - one.base_score) * one.held_out
    assert gain > 0


def test_probabilities_after_any_context_sum_to_one(spark):
    texts = ["a b c a b", "a b d", "", None, "C c c a\tb"]
    model = kneser_ney.train(spark.createDataFrame([(t, 1) for t in texts], "text string, word int"))
    brute = Brute(texts)
    words = [word for word in brute.counts] + [b"unseen"]
    for context in [b"<s> ", *brute.counts, b"other"]:
        assert sum(brute.probability(context, word) for word in words) == pytest.approx(1)
    asked = [*texts, "z z a", "b a b " * 1000]
    frame = spark.createDataFrame([(n, t, 2.0) for n, t in enumerate(asked)], "doc_id long, text string, score double")
    for row in kneser_ney.score(frame, model).collect():
        assert (row.n_tokens, row.n_known, row.base_score, row.score) == pytest.approx(brute.score(asked[row.row.doc_id]))


@pytest.mark.parametrize("texts", [[], [None], ["", " "]])
def test_little_or_nothing_to_learn_from(spark, texts):
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    brute = Brute(texts)
    (row,) = kneser_ney.score(spark.createDataFrame([("a b",)], "text string"), model).collect()
    assert row.n_tokens == 3 and row.score == pytest.approx(brute.score("a b")[3])
    assert kneser_ney.score(spark.createDataFrame([], "text string"), model).count() == 0


def test_folders_that_cannot_be_mapped_are_refused(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "scratch_path", lambda *_: "hdfs://store/tmp/x")
    with pytest.raises(ValueError, match="mounted"):
        kneser_ney.mounted_folder(spark, "x")


def test_packing_is_exact():
    import numpy as np

    keys, counts = np.array([3, 3, 9, 1 << 63], "<u8"), np.array([1, 2, 3, 4], "<u4")
    for own, back in zip((keys, counts), kneser_ney.unpack(kneser_ney.pack(keys, counts), "<u8", "<u4"), strict=True):
        assert (own == back).all()


class LongBrute:
    """The model of longer runs from dictionaries. Nothing stands before the start mark, so runs with it keep their counts."""

    def __init__(self, texts, order):
        self.order, split = order, [[b"<s> ", *tokens_of(text)] for text in texts]
        self.counts = Counter(token for tokens in split for token in tokens[1:])
        runs = {k: Counter(tuple(t[i : i + k]) for t in split for i in range(len(t) - k + 1)) for k in range(2, order + 1)}
        self.levels = {order: runs[order]}
        for k in range(order - 1, 1, -1):
            left = Counter(run[1:] for run in runs[k + 1])
            self.levels[k] = {run: n if run[0] == b"<s> " else left[run] for run, n in runs[k].items()}
        self.levels[1] = Counter(run[1:] for run in runs[2])
        self.by = {k: Brute.discount(level.values()) for k, level in self.levels.items()}
        self.after, self.rest = Counter(), Counter()
        for k, level in self.levels.items():
            for run, n in level.items():
                self.after[run[:-1]] += n
                self.rest[run[:-1]] += self.by[k][min(n, 3) - 1]

    def probability(self, context, word):
        if context and context not in self.after:
            return self.probability(context[1:], word)
        by, after = self.by[len(context) + 1], self.after[context]
        n = self.levels[len(context) + 1].get((*context, word), 0)
        own = max(n - by[min(n, 3) - 1], 0) if n else 0
        lower = self.probability(context[1:], word) if context else 1 / (len(self.counts) + 1)
        return (own + self.rest[context] * lower) / after if after else lower

    def score(self, text):
        tokens = [b"<s> ", *tokens_of(text)]
        return sum(math.log10(self.probability(tuple(tokens[max(0, i - self.order + 1) : i]), tokens[i])) for i in range(1, len(tokens)))


@pytest.mark.parametrize("order", [3, 4])
def test_longer_runs_agree_with_dictionaries(spark, order):
    rows = load(spark, "documents").select("doc_id", "text").limit(120).collect()
    texts = [row.text for row in rows[:90]] + ["a b c a b", "a b c", "", None, "C c c a\tb"]
    asked = [row.text for row in rows[80:]] + ["", None, "z z a b c", "a b c a " * 1000]
    brute = LongBrute(texts, order)
    seen = [*brute.counts, b"unseen"]
    for context in [(b"<s> ",), (b"<s> ", b"a"), (b"a", b"b"), (b"c", b"a", b"b"), (b"z", b"b")]:
        assert sum(brute.probability(context[-order + 1 :], word) for word in seen) == pytest.approx(1)
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), order=order)
    frame = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    for row in kneser_ney.score(frame, model).collect():
        assert row.score == pytest.approx(brute.score(asked[row.row.doc_id]), rel=1e-9)


@pytest.mark.parametrize("texts", [[], [None], ["", " "]])
def test_longer_runs_of_little_or_nothing(spark, texts):
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    (row,) = kneser_ney.score(spark.createDataFrame([("a b",)], "text string"), model).collect()
    assert row.n_tokens == 3 and row.score == pytest.approx(LongBrute(texts, 3).score("a b"))
    with pytest.raises(ValueError, match="order"):
        kneser_ney.train(spark.createDataFrame([], "text string"), order=1)


def test_a_pair_may_be_counted_over_four_billion_times(tmp_path, monkeypatch):
    class Attempt:
        def taskAttemptId(self):  # noqa: N802
            return 1

    monkeypatch.setattr(kneser_ney.TaskContext, "get", lambda: Attempt())
    keys = np.array([5 << 32 | 7, 5 << 32 | 8], "<u8")
    piece = kneser_ney.pack(keys, np.array([4_000_000_000, 3], "<u4"))
    rows = pa.table({"target": pa.array([0, 0], pa.int64()), "piece": pa.array([piece, piece], pa.binary())})
    found = kneser_ney.write_pairs(str(tmp_path), 1, 20)((pa.scalar(0),), rows)
    known, counts = kneser_ney.pair_part(str(tmp_path), 0)
    assert (known.tolist(), counts.tolist()) == (keys.tolist(), [8_000_000_000, 6])
    total = kneser_ney.unpack(found.column("piece")[0].as_py(), *["<i8"] * 6)[1]
    assert max(total.tolist()) == 8_000_000_006
    absent = kneser_ney.pair_part(str(tmp_path), 1)
    assert [len(part) for part in absent] == [0, 0]


def test_too_many_words_are_an_error(spark, monkeypatch):
    class Many:
        words, tokens = 1 << 32, 1 << 40

    monkeypatch.setattr(kneser_ney, "count_words", lambda rows, folder: Many())
    with pytest.raises(ValueError, match="words"):
        kneser_ney.train(spark.createDataFrame([("a",)], "text string"))


def test_score_keeps_named_columns(spark):
    frame = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id int, text string, row string")
    model = kneser_ney.train(frame)
    assert kneser_ney.score(frame, model, keep=["doc_id"]).select("row.*").columns == ["doc_id"]
    assert kneser_ney.score(frame, model).select("row.*").columns == frame.columns
