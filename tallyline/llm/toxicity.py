"""Toxicity of documents whose words may be disguised: a noisy channel restores the words before they are scored.

A disguised word is one written with digits and signs for letters (``1d10t``), with marks or spaces between its letters
(``i.d.i.o.t``, ``i d i o t``) or with letters repeated (``idiooot``). It is taken for what a channel made of a plain word:
each sign may stand for each of its ``SIGNS`` letters, a mark may have been put in or may part two words, a repeated letter
may have been put in. These choices span a lattice of characters, and Viterbi decoding finds the path that is likeliest under
the channel and a character trigram model. A word of letters without triple letters has one path, itself.

The character model is counted over all documents: trigrams of a closed alphabet (a-z, the letters of Latin-1, one class for
all other letters, one for what is between words), 216,000 cells at most, whatever the corpus. It is interpolated with
bigrams and single characters.

A document's words, as written and as restored, are looked up with their stems (prefixes of ``STEMS`` letters) in a table of
evidence learnt from labelled documents. For each word and stem the documents that have it are counted by label, and it is
evidence if its G statistic against the share of toxic documents is beyond ``log(all words and stems) + MARGIN``, so that
chance hardly makes any. A document's strongest evidence is the word or stem with the largest share of toxic documents,
smoothed; its score is the share of toxic documents among the learnt ones with evidence about as strong, or with none, made
monotonous by pooling neighbouring steps.

At most ``most_labelled`` labelled documents are learnt from, those with the smallest hashes of their ids; this bounds the
table of evidence. Long tokens and long runs of single letters are decoded in overlapping pieces of ``PIECE`` characters;
each word of up to half a piece lies in one of them whole. Null texts are empty. Labels without an id or a value and those
of unknown documents are left out, and of several labels of an id the largest counts. Without labels every score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import words as W
from tallyline.llm.frames import ROW, whole_rows, written

MOST_LABELLED = 8_000
STEMS = range(3, 9)
MARGIN = 5.0
PIECE = 64
REMEMBERED_BYTES = 48 << 20
ENTRY_BYTES = 160
SLICE_BYTES = 1 << 20

# Which letters a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
# Costs, as negative natural logarithms, of what the channel does to a plain word.
SIGN_COST = 1.5
MARK_COST = 0.7
REPEAT_COST = 1.0
BREAK_COST = 2.0
LATIN = "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
ALPHABET = " abcdefghijklmnopqrstuvwxyz" + LATIN
OTHER = len(ALPHABET)
SYMBOLS = OTHER + 1
TABLE = 0x250
MARKS = r"[^\W\d_]"
LETTERS = re.compile(rf"{MARKS}+")
TRIPLE = re.compile(rf"({MARKS})\1\1")
SPACED = re.compile(r" (\S(?: \S){2,})(?= )")
EDGES = re.compile(r"^(?:[^\w@$]|_)+|(?:[^\w@$]|_)+$|[@$]{3,}$|^[@$]{3,}")
GAP = "·"
FLUSHED = 200_000
LEVELS = 50
COUNTS = "code int, n bigint"


def symbol_table() -> np.ndarray:
    """Numbers of the characters below ``TABLE``: letters of either case alike, 0 for what is no letter."""
    table = np.zeros(TABLE + 1, dtype=np.int64)
    for code in range(TABLE):
        letter = chr(code).lower()
        if letter.isalpha():
            table[code] = ALPHABET.index(letter) if letter in ALPHABET else OTHER
    table[TABLE] = OTHER
    return table


SYMBOL_TABLE = symbol_table()


def symbols(text: str) -> np.ndarray:
    """The text's characters as numbers; beyond ``TABLE`` all count as other letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return SYMBOL_TABLE[np.minimum(codes, TABLE)]


def trigram_codes(numbers: np.ndarray) -> np.ndarray:
    """Codes of trigrams that end inside words or right after them; what is before a word's start is a space."""
    x, y, z = numbers[:-2], numbers[1:-1], numbers[2:]
    return ((np.where(y > 0, x, 0) * SYMBOLS + y) * SYMBOLS + z)[(y > 0) | (z > 0)]


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    before = np.zeros(2, dtype=np.int64)
    for batch in batches:
        for part in W.slices(batch, "text", SLICE_BYTES):
            joined = "".join(f"{text}\n" for text in part.column("text").to_pylist() if text)
            for start in range(0, len(joined), SLICE_BYTES):
                numbers = np.concatenate([before, symbols(joined[start : start + SLICE_BYTES])])
                total += np.bincount(trigram_codes(numbers), minlength=len(total))
                before = numbers[-2:]
    codes = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(total[codes])], names=["code", "n"])


@dataclass(frozen=True)
class Language:
    """``cost[x, y, z]``: the negative logarithm of the chance of ``z`` after ``x`` and ``y``."""

    cost: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray) -> Language:
        found = np.zeros(SYMBOLS**3)
        found[codes] = counts
        three = found.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        uniform = (one + 1) / (one.sum() + SYMBOLS)
        after = (two + 5 * uniform) / (two.sum(axis=1, keepdims=True) + 5)
        chance = (three + 5 * after) / (three.sum(axis=2, keepdims=True) + 5)
        return cls(-np.log(chance).astype(np.float32))


def number(letter: str) -> int:
    code = ord(letter)
    return int(SYMBOL_TABLE[min(code, TABLE)]) if letter.isalpha() or code >= TABLE else 0


def arcs(text: str) -> Iterator[list[tuple[str, float]]]:
    """What each character may stand for, with its cost: letters, nothing (``""``) or the end of a word (``" "``)."""
    for place, letter in enumerate(text):
        if letter.isalpha():
            own = [(letter, 0.0)]
            if place and letter == text[place - 1]:
                own.append(("", REPEAT_COST))
        else:
            own = [(sign, SIGN_COST) for sign in SIGNS.get(letter, "")]
            if not letter.isdigit():
                own.append(("", MARK_COST))
            if place and place + 1 < len(text):
                own.append((" ", BREAK_COST))
            if place and letter == text[place - 1]:
                own.append(("", REPEAT_COST))
        yield own


def decode(text: str, language: Language) -> str:
    """The likeliest plain words behind the text: the cheapest path of the lattice, its costs and those of the trigrams."""
    cost = language.cost
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for own in arcs(text):
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (x, y), (total, path) in states.items():
            for letter, price in own:
                if letter == "":
                    key, value, way = (x, y), total + price, path
                elif letter == " ":
                    if y == 0:
                        continue
                    key, value, way = (0, 0), total + price + float(cost[x, y, 0]), (letter, path)
                else:
                    z = number(letter)
                    key, value, way = (y, z), total + price + float(cost[x, y, z]), (letter, path)
                if key not in following or value < following[key][0]:
                    following[key] = (value, way)
        states = following or states
    _, path = min((total + (float(cost[x, y, 0]) if y else 0.0), n, way) for n, ((x, y), (total, way)) in enumerate(states.items()))[::2]
    letters = []
    while path is not None:
        letter, path = path
        letters.append(letter)
    return "".join(reversed(letters))


def pieces(text: str) -> Iterator[str]:
    """The text, or overlapping pieces of a long one."""
    if len(text) <= PIECE:
        yield text
    else:
        for start in range(0, len(text) - PIECE // 2, PIECE // 2):
            yield text[start : start + PIECE]


def token_words(token: str, language: Language) -> set[str]:
    """The words of a token as written, and as restored if it may be disguised."""
    if token.isalpha() and not TRIPLE.search(token):
        return {token}
    found = set(LETTERS.findall(token))
    bare = EDGES.sub("", token)
    if found and (not bare.isalpha() or TRIPLE.search(bare)):
        for piece in pieces(bare):
            found.update(decode(piece, language).split(" "))
    found.discard("")
    return found


def spaced_words(words: list[str], language: Language) -> set[str]:
    """The words behind runs of at least three single characters with spaces between them."""
    found: set[str] = set()
    for run in SPACED.finditer(f" {' '.join(words)} "):
        for piece in pieces(run.group(1)[::2]):
            found.update(decode(GAP.join(piece), language).split(" "))
    found.discard("")
    return found


def features(word: str) -> Iterator[str]:
    """A word and its stems."""
    yield word + "$"
    for size in STEMS:
        if len(word) < size:
            break
        yield word[:size]


class Reader:
    """The words of texts; what tokens stand for is remembered within a bound of bytes."""

    def __init__(self, language: Language, value) -> None:
        self.language, self.value = language, value
        self.known: dict[str, object] = {}
        self.held = 0

    def values(self, text: str) -> list:
        """``value`` of the words behind each token of the text and behind its runs of spaced letters."""
        if self.held > REMEMBERED_BYTES:
            self.known, self.held = {}, 0
        words = text.lower().split()
        tokens = set(words)
        known = self.known
        for token in tokens.difference(known):
            known[token] = self.value(token_words(token, self.language))
            self.held += ENTRY_BYTES + len(token)
        found = list(map(known.__getitem__, tokens))
        spaced = spaced_words(words, self.language)
        return [*found, self.value(spaced)] if spaced else found


def learn_language(documents: DataFrame, text: str) -> Language:
    counts = documents.select(F.col(f"`{text}`").alias("text")).mapInArrow(count_trigrams, COUNTS)
    table = counts.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return Language.of(table.column("code").to_numpy(), table.column("n").to_numpy())


def chosen_labels(labels: DataFrame, doc_id: str, label: str, most: int) -> DataFrame:
    return (
        labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("double").alias("label"))
        .dropna()
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )


def labelled_texts(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    """``id``, ``label`` and ``text`` of at most ``most`` documents; of texts with the same id the smallest."""
    chosen = written(chosen_labels(labels, doc_id, label, most), "labels")
    texts = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    joined = texts.join(F.broadcast(chosen), "id")
    return written(joined.groupBy("id").agg(F.max("label").alias("label"), F.min(F.coalesce("text", F.lit(""))).alias("text")), "learnt")


def counted_features(language):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of the task with each word and stem, and how many of them are toxic."""
        reader = Reader(language.value, lambda words: {feature for word in words for feature in features(word)})
        counts: dict[str, list[float]] = {}

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(counts, pa.string()), *(pa.array([own[n] for own in counts.values()], pa.float64()) for n in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, names=["feature", "n", "toxic"])

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                for feature in set().union(*reader.values(text.as_py())):
                    own = counts.setdefault(feature, [0.0, 0.0])
                    own[0] += 1
                    own[1] += label
                if len(counts) > FLUSHED:
                    yield flushed()
                    counts.clear()
        yield flushed()

    return count


@dataclass(frozen=True)
class Evidence:
    """The shares of toxic documents among those with a word or stem."""

    shares: dict[str, float]

    def best(self, words: set[str]) -> float:
        get = self.shares.get
        return max((get(feature, 0.0) for word in words for feature in features(word)), default=0.0)


def monotonous(steps: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """From (level, toxic, number) by level, the shares of toxic ones from each level on, neighbours pooled until they rise."""
    pools: list[list[float]] = []
    for level, toxic, n in steps:
        pools.append([level, toxic, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, toxic, n = pools.pop()
            pools[-1][1] += toxic
            pools[-1][2] += n
    return [(level, toxic / n) for level, toxic, n in pools]


def best_evidence(language, known):
    """Adds ``best``, the largest share among a text's evidence or 0, to the other columns."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(language.value, known.value.best)
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                best = [max(reader.values(text or ""), default=0.0) for text in part.column("text").to_pylist()]
                rest = [name for name in part.schema.names if name != "text"]
                columns = [*(part.column(name) for name in rest), pa.array(best, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*rest, "best"])

    return judge


def learn_evidence(sample: DataFrame, language) -> tuple[Evidence, list[tuple[float, float]]]:
    """The evidence and the steps from its strength to scores."""
    base = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    if not base["n"]:
        return Evidence({}), [(0.0, 0.5)]
    prior = min(max(base["toxic"] / base["n"], 1e-6), 1 - 1e-6)
    parts = sample.select("label", "text").mapInArrow(counted_features(language), "feature string, n double, toxic double")
    counted = written(parts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")), "counts")
    least = log(max(1, counted.count())) + MARGIN
    share, clean = F.col("toxic") / F.col("n"), F.col("n") - F.col("toxic")
    gain = F.col("toxic") * F.log(share / prior) + F.when(clean > 0, clean * F.log((1 - share) / (1 - prior))).otherwise(0.0)
    smoothed = (F.col("toxic") + prior) / (F.col("n") + 1)
    evidence = counted.where((share > prior) & (gain > least)).select("feature", smoothed.alias("share"))
    found = Evidence({row.feature: row.share for row in evidence.collect()})
    known = sample.sparkSession.sparkContext.broadcast(found)
    judged = sample.select("label", "text").mapInArrow(best_evidence(language, known), "label double, best double")
    levels = judged.groupBy(F.floor(F.col("best") * LEVELS).alias("level")).agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n"))
    steps = [(row.level / LEVELS, row.toxic + prior, row.n + 1) for row in levels.orderBy("level").collect()]
    return found, [(0.0, steps[0][1] / steps[0][2]), *monotonous(steps)]


def score(
    documents: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most_labelled: int = MOST_LABELLED,
    keep: list[str] | None = None,
) -> DataFrame:
    """Each document as ``row`` beside its ``score``, from 0 to 1: higher where label 1 is likelier."""
    context = documents.sparkSession.sparkContext
    language = context.broadcast(learn_language(documents, text))
    sample = labelled_texts(documents, labels, doc_id, text, label, most_labelled)
    evidence, steps = learn_evidence(sample, language)
    frame = whole_rows(documents, keep, text=text)
    judged = frame.mapInArrow(best_evidence(language, context.broadcast(evidence)), frame.select(ROW, F.lit(0.0).alias("best")).schema)
    found = F.lit(steps[0][1])
    for level, share in steps[1:]:
        found = F.when(F.col("best") >= level, share).otherwise(found)
    return judged.select(ROW, found.alias("score"))
