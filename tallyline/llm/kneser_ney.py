"""An interpolated modified Kneser-Ney model of word pairs, or of longer runs of words, counted in Spark and read from sorted arrays in mapped files.

Words are what stands between white space, with A-Z in lower case; each text ends with an end token, and its first word
follows a start mark. All counts go over all training texts:

1. Words are counted by their 64-bit hashes. The sorted hashes are the vocabulary; a word's number is its place in it.
2. Each task counts the pairs of a slice of text and packs them, sorted, into one row for each shard of the pairs' hashes.
   A task for each shard adds them up and writes the sorted pairs and their counts. A pair that is very frequent is one
   entry for each slice, however often it occurs there.
3. From its distinct pairs each shard adds up, by word number, what smoothing needs: total and numbers of counts 1, 2 and
   more after a context, and the number of contexts before a word. Packed again, these go to ranges of word numbers,
   whose tasks write them as arrays.

The probability of a word after a context is its discounted count, plus the context's left-over mass times the word's
discounted number of contexts, plus that level's left-over mass times an equal share for all words and one unknown. After an
unknown context only the lower levels count.

With ``order`` 3 or more, runs of that many tokens are counted as well. A run is its context's number, which is its place in
all shards of the runs one token shorter, and its last word; its shard gets its count and the number of the run without the
first token. Then, from the longest runs down, each shard hands to the shards of the runs one token shorter what smoothing
needs after a context, and how many distinct tokens stand before a run: for runs shorter than ``order`` this number takes the
place of the count, but for runs with the start mark, before which nothing stands. The probability after the shorter context
is what a level's left-over mass is dealt by. No run goes beyond the start mark.

Discounts are 0.5, 1 and 1.5 where the counts of counts give none.

Scoring maps the arrays and looks up the sorted distinct pairs of each slice of text, so that only pages in use are held
and nothing of the documents is shuffled. For this the shared folder (``spark.checkpoint.dir``) must be mounted as a
``file:`` path on all machines; other file systems are refused. Tasks write under another name and rename, so a task that
runs again leaves the same files.

Null texts are empty, and an empty text is an end token after a start mark.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import words as W
from tallyline.llm.frames import shuffle_partitions, whole_rows, written
from tallyline.session import scratch_path

SLICE_BYTES = 6 << 20
SHARD_TOKENS = 1_500_000
RANGE_WORDS = 200_000
UNKNOWN_COUNT = 0.1
FALLBACK = (0.5, 1.0, 1.5)
ORDER = 2
# How many shards a worker keeps mapped; the kernel bounds the maps of a process.
MAPPED_SHARDS = 4096
NO_PART = (np.zeros(0, dtype="<u8"), np.zeros(0, dtype="<i8"))
STATISTICS = ("total", "ones", "twos", "more", "before")
RESULT = "n_tokens bigint, n_known bigint, base_score double, score double"


def mounted_folder(spark: SparkSession, label: str) -> str:
    """A new folder that all machines can map files from."""
    parts = urlparse(scratch_path(spark, label))
    if parts.scheme not in ("", "file"):
        raise ValueError("the model's files must be in a mounted folder: set spark.checkpoint.dir to a file: path")
    path = unquote(parts.path)
    os.makedirs(path)
    return path


def write_array(path: str, values: np.ndarray) -> None:
    own = f"{path}.{os.getpid()}.{TaskContext.get().taskAttemptId()}"
    values.tofile(own)
    os.replace(own, path)


def mapped(path: str, kind: str) -> np.ndarray:
    if not os.path.getsize(path):
        return np.zeros(0, dtype=kind)
    return np.memmap(path, dtype=kind, mode="r")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed piece; the first one is sorted and kept as differences."""
    first = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    body = b"".join(array.tobytes() for array in (first, *arrays[1:]))
    return struct.pack("<Q", len(first)) + zstandard.compress(body, 1)


def unpack(piece: bytes, *kinds: str) -> list[np.ndarray]:
    (count,) = struct.unpack_from("<Q", piece)
    body, at, out = zstandard.decompress(piece[8:]), 0, []
    for kind in kinds:
        out.append(np.frombuffer(body, kind, count, at))
        at += out[-1].nbytes
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and the sums of the values of each."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[heads], *[np.add.reduceat(value[order], heads) for value in values]]


@dataclass(frozen=True)
class Vocabulary:
    """Sorted hashes and counts of the training words, in part files; ``sizes`` are the words of each part."""

    folder: str
    sizes: tuple[int, ...]
    texts: int
    tokens: int

    @property
    def words(self) -> int:
        return sum(self.sizes)

    @property
    def end(self) -> int:
        return self.words

    @property
    def start(self) -> int:
        return self.words + 1

    @property
    def distinct(self) -> int:
        """Distinct training tokens, the end token included."""
        return self.words + (1 if self.texts else 0)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, or -1, and counts of words with these hashes, which must be sorted."""
        numbers, counts, first = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64), 0
        for (known, often), size in zip(vocabulary_parts(self.folder, len(self.sizes)), self.sizes, strict=True):
            if size:
                low, high = np.searchsorted(hashes, [known[0], known[-1]])
                part = slice(low, high + 1)
                place = np.minimum(np.searchsorted(known, hashes[part]), size - 1)
                hit = known[place] == hashes[part]
                numbers[part][hit] = place[hit] + first
                counts[part][hit] = often[place[hit]]
            first += size
        return numbers, counts


@lru_cache(maxsize=2)
def vocabulary_parts(folder: str, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(mapped(f"{folder}/words-{n}", "<u8"), mapped(f"{folder}/word-counts-{n}", "<i8")) for n in range(count)]


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text", SLICE_BYTES):
            split = W.split(part.column("text"), W.NOT_SPACES, lower=True)
            values, counts = np.unique(W.hashes(split), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((values ^ TOP).view(np.int64)), pa.array(counts)], names=["word", "n"])


TOP = np.uint64(1 << 63)


def count_words(texts: DataFrame, folder: str) -> Vocabulary:
    """Writes the vocabulary. Spark sorts signed numbers, so hashes travel with their top bit turned over."""
    spark = texts.sparkSession
    counted = written(texts.mapInArrow(word_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        columns = [(batch.column("word").to_numpy().view(np.uint64) ^ TOP, batch.column("n").to_numpy()) for batch in batches]
        words = np.concatenate([np.zeros(0, np.uint64), *[own for own, _ in columns]])
        counts = np.concatenate([np.zeros(0, np.int64), *[own for _, own in columns]])
        write_array(f"{folder}/words-{number}", words.astype("<u8"))
        write_array(f"{folder}/word-counts-{number}", counts.astype("<i8"))
        yield pa.RecordBatch.from_pylist([{"part": number, "words": len(words), "tokens": int(counts.sum())}])

    parts = max(1, counted.count() // RANGE_WORDS)
    if counted.isEmpty():
        return Vocabulary(folder, (), texts.count(), texts.count())
    ordered = counted.repartitionByRange(parts, "word").sortWithinPartitions("word")
    rows = ordered.mapInArrow(write, "part bigint, words bigint, tokens bigint").collect()
    sizes = dict.fromkeys(range(max(row.part for row in rows) + 1), 0) | {row.part: row.words for row in rows}
    count = texts.count()
    return Vocabulary(folder, tuple(sizes.values()), count, count + sum(row.tokens for row in rows))


def numbered(column: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers (-1 unknown) and counts of all tokens of some texts, each with its end, and the texts' bounds."""
    split = W.split(column, W.NOT_SPACES, lower=True)
    words, where = np.unique(W.hashes(split), return_inverse=True)
    numbers, counts = vocabulary.find(words)
    first = split.first + np.arange(len(split.first))
    tokens, known = np.full(first[-1], vocabulary.end, dtype=np.int64), np.full(first[-1], vocabulary.texts, dtype=np.int64)
    inside = np.ones(first[-1], dtype=bool)
    inside[first[1:] - 1] = False
    tokens[inside], known[inside] = numbers[where], counts[where]
    return tokens, known, first


def contexts(tokens: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = start
    return before


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return before.astype(np.uint64) << np.uint64(32) | tokens.astype(np.uint64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (W.mix(keys) % np.uint64(shards)).astype(np.int64)


def count_pairs(vocabulary: Vocabulary, shards: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                tokens, _, first = numbered(part.column("text"), vocabulary)
                keys, counts = np.unique(pair_keys(contexts(tokens, first, vocabulary.start), tokens), return_counts=True)
                yield from packed_rows(shard_of(keys, shards), keys.astype("<u8"), counts.astype("<u4"))

    return count


@dataclass(frozen=True)
class Runs:
    """Sorted keys and counts of all runs of ``order`` tokens, in shards; ``bounds`` are the numbers of their first runs."""

    folder: str
    order: int
    bounds: tuple[int, ...]
    counts: str

    @property
    def number(self) -> int:
        return self.bounds[-1]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, or -1, and counts of runs with these distinct keys, which must be sorted."""
        numbers, counts = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        shards = len(self.bounds) - 1
        target = shard_of(keys, shards)
        order = np.argsort(target, kind="stable")
        ends = np.cumsum(np.bincount(target, minlength=shards))
        for number in np.unique(target).tolist():
            own = order[(ends[number - 1] if number else 0) : ends[number]]
            known, often = run_part(self.folder, self.order, self.counts, number)
            if len(known):
                place = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
                hit = known[place] == keys[own]
                numbers[own] = np.where(hit, place + self.bounds[number], -1)
                counts[own] = np.where(hit, often[place], 0)
        return numbers, counts


def written_runs(folder: str, order: int, shards: int) -> Runs:
    """The runs that tasks have written, with raw counts."""
    paths = [f"{folder}/runs-{order}-{n}" for n in range(shards)]
    sizes = [os.path.getsize(path) // 8 if os.path.exists(path) else 0 for path in paths]
    if sum(sizes) > 1 << 32:
        raise ValueError(f"more than {1 << 32:,} runs of {order} tokens: their numbers don't fit into the keys of longer runs")
    return Runs(folder, order, (0, *np.cumsum(sizes).tolist()), "raw")


def chain(tokens: np.ndarray, first: np.ndarray, vocabulary: Vocabulary, levels: list[Runs]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each level numbers of the contexts of tokens, numbers and counts of the runs that end with them; -1 if unknown."""
    numbers = tokens
    for level in levels:
        before = contexts(numbers, first, vocabulary.start if level.order == 2 else -1)
        known = (before >= 0) & (tokens >= 0)
        keys, place = np.unique(pair_keys(before[known], tokens[known]), return_inverse=True)
        found, often = level.find(keys)
        numbers, counts = np.full(len(tokens), -1, dtype=np.int64), np.zeros(len(tokens), dtype=np.int64)
        numbers[known], counts[known] = found[place], often[place]
        yield before, numbers, counts


def count_runs(vocabulary: Vocabulary, levels: list[Runs], shards: int):
    """Counts runs one token longer than those of the last level."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                tokens, _, first = numbered(part.column("text"), vocabulary)
                numbers = tokens
                for _, own, _ in chain(tokens, first, vocabulary, levels):
                    numbers = own
                before = contexts(numbers, first, vocabulary.start if not levels else -1)
                known = before >= 0
                keys, at, counts = np.unique(pair_keys(before[known], tokens[known]), return_index=True, return_counts=True)
                shorter = numbers[known][at]
                yield from packed_rows(shard_of(keys, shards), keys.astype("<u8"), counts.astype("<u4"), shorter.astype("<u4"))

    return count


def write_runs(folder: str, order: int):
    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        """Writes a shard's runs, their raw counts and the numbers of the runs without the first token."""
        shard = key[0].as_py()
        pieces = [unpack(piece.as_py(), "<u8", "<u4", "<u4") for piece in rows.column("piece")]
        keys, counts, shorter = (np.concatenate(columns) for columns in zip(*pieces, strict=True))
        del pieces
        by = np.argsort(keys, kind="stable")
        keys = keys[by]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        write_array(f"{folder}/raw-{order}-{shard}", np.add.reduceat(counts[by], heads, dtype=np.int64))
        write_array(f"{folder}/shorter-{order}-{shard}", shorter[by][heads])
        write_array(f"{folder}/runs-{order}-{shard}", keys[heads])
        return pa.table({"target": pa.array([shard], pa.int64()), "piece": pa.array([b""], pa.binary())})

    return merge


def settle_runs(level: Runs, longest: bool, below: tuple[int, ...]):
    """``below`` are the bounds of the runs one token shorter, or of the ranges of word numbers."""

    def settle(key: tuple, rows: pa.Table) -> pa.Table:
        """Writes a shard's statistics after its runs and the counts that hold for its level, returns what is handed down."""
        shard = key[0].as_py()
        path = f"{level.folder}/{{}}-{level.order}-{shard}"
        keys, counts = mapped(path.format("runs"), "<u8"), mapped(path.format("raw"), "<i8")
        if not longest:
            pieces = [unpack(piece.as_py(), *["<i8"] * 6) for piece in rows.column("piece") if piece.as_py()]
            if pieces:
                numbers, *values = summed(*[np.concatenate(columns) for columns in zip(*pieces, strict=True)])
                dense = np.zeros((5, len(keys)), dtype="<i8")
                dense[:, numbers - level.bounds[shard]] = values
                for name, own in zip(STATISTICS[:4], dense, strict=False):
                    write_array(path.format(name), own)
                counts = np.where(dense[4] > 0, dense[4], counts)
        write_array(path.format("settled"), counts.astype("<i8"))
        context = (keys >> np.uint64(32)).astype(np.int64)
        number, *values = summed(context, counts, *[(counts == n).astype(np.int64) for n in (1, 2)], (counts > 2).astype(np.int64))
        shorter = mapped(path.format("shorter"), "<u4").astype(np.int64)
        shorter, times = np.unique(shorter, return_counts=True)
        none = [np.zeros(len(shorter), dtype=np.int64)] * 4
        values = [np.concatenate([own, other]) for own, other in zip(values, none, strict=True)]
        values.append(np.concatenate([np.zeros(len(number), dtype=np.int64), times]))
        number, *values = summed(np.concatenate([number, shorter]), *values)
        target = np.searchsorted(np.array(below), number, side="right") - 1
        batches = list(packed_rows(target, number.astype("<i8"), *[value.astype("<i8") for value in values]))
        counted = pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int64()), pa.array([np.array([len(keys), *counts_of_counts(counts)], "<i8").tobytes()], pa.binary())],
            names=["target", "piece"],
        )
        return pa.Table.from_batches([*batches, counted])

    return settle


@lru_cache(maxsize=MAPPED_SHARDS)
def run_part(folder: str, order: int, counts: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
    runs, often = f"{folder}/runs-{order}-{shard}", f"{folder}/{counts}-{order}-{shard}"
    return (mapped(runs, "<u8"), mapped(often, "<i8")) if os.path.exists(runs) else NO_PART


@lru_cache(maxsize=4096)
def run_statistics(folder: str, order: int, shard: int) -> list[np.ndarray]:
    paths = [f"{folder}/{name}-{order}-{shard}" for name in STATISTICS[:4]]
    return [mapped(path, "<i8") if os.path.exists(path) else np.zeros(0, dtype="<i8") for path in paths]


def packed_rows(target: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each target with its share of the arrays, which are in the order of the first."""
    order = np.argsort(target, kind="stable")
    ends = np.cumsum(np.bincount(target)) if len(target) else np.zeros(0, dtype=np.int64)
    targets = np.unique(target)
    pieces = [pack(*[array[order[(ends[n - 1] if n else 0) : ends[n]]] for array in arrays]) for n in targets.tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(targets, pa.int64()), pa.array(pieces, pa.binary())], names=["target", "piece"])


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == n).sum()) for n in (1, 2, 3, 4)]


def write_pairs(folder: str, ranges: int, numbers: int):
    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        """Writes a shard's pairs; returns its share of the statistics by ranges of word numbers, and counts of counts."""
        shard = key[0].as_py()
        pieces = [unpack(piece.as_py(), "<u8", "<u4") for piece in rows.column("piece")]
        keys, counts = summed(np.concatenate([own for own, _ in pieces]), np.concatenate([own for _, own in pieces]).astype(np.int64))
        write_array(f"{folder}/pairs-{shard}", keys.astype("<u8"))
        write_array(f"{folder}/pair-counts-{shard}", counts.astype("<i8"))
        before, after = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        left = summed(before, counts, *[(counts == n).astype(np.int64) for n in (1, 2)], (counts > 2).astype(np.int64))
        words, contexts_before = np.unique(after, return_counts=True)
        both = np.concatenate([left[0], words])
        none = [np.zeros(len(words), dtype=np.int64)] * 4
        values = [np.concatenate([own, other]) for own, other in zip(left[1:], none, strict=True)]
        values.append(np.concatenate([np.zeros(len(left[0]), dtype=np.int64), contexts_before]))
        number, *values = summed(both, *values)
        width = -(-numbers // ranges)
        batches = list(packed_rows(number // width, number.astype("<i8"), *[value.astype("<i8") for value in values]))
        counted = pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int64()), pa.array([np.array([len(keys), *counts_of_counts(counts)], "<i8").tobytes()], pa.binary())],
            names=["target", "piece"],
        )
        return pa.Table.from_batches([*batches, counted])

    return merge


def write_statistics(folder: str, ranges: int, numbers: int):
    width = -(-numbers // ranges)

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        """Writes the statistics of a range of word numbers; returns counts of counts of the contexts before words."""
        number = key[0].as_py()
        pieces = [unpack(piece.as_py(), *["<i8"] * 6) for piece in rows.column("piece")]
        words, *values = summed(*[np.concatenate(columns) for columns in zip(*pieces, strict=True)])
        dense = np.zeros((5, width), dtype="<i8")
        dense[:, words - number * width] = values
        for name, own in zip(STATISTICS, dense, strict=True):
            write_array(f"{folder}/{name}-{number}", own)
        before = dense[-1]
        found = [number, int((before > 0).sum()), *counts_of_counts(before)]
        return pa.table({"piece": pa.array([np.array(found, "<i8").tobytes()], pa.binary())})

    return merge


def discounts(counted: np.ndarray) -> tuple[float, float, float]:
    """Discounts for counts 1, 2 and more from the numbers of counts 1 to 4."""
    one, two, three, four = (float(n) for n in counted)
    if not one or not two or not three:
        return FALLBACK
    share = one / (one + 2 * two)
    found = (1 - 2 * share * two / one, 2 - 3 * share * three / two, 3 - 4 * share * four / three)
    return found if all(0 < own < most for own, most in zip(found, (1, 2, 3), strict=True)) else FALLBACK


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that hold for all words."""

    vocabulary: Vocabulary
    shards: int
    ranges: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float
    levels: tuple[Runs, ...] = ()
    level_discounts: tuple[tuple[float, float, float], ...] = ()

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs, 0 for unknown ones."""
        out = np.zeros(len(keys), dtype=np.int64)
        if not self.pairs:
            return out
        target = shard_of(keys, self.shards)
        order = np.argsort(target, kind="stable")
        ends = np.cumsum(np.bincount(target, minlength=self.shards))
        for number in np.unique(target).tolist():
            own = order[(ends[number - 1] if number else 0) : ends[number]]
            known, counts = pair_part(self.vocabulary.folder, number)
            if len(known):
                place = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
                out[own] = np.where(known[place] == keys[own], counts[place], 0)
        return out

    def statistics(self, numbers: np.ndarray) -> list[np.ndarray]:
        """The statistics of words with these numbers; 0 for -1."""
        out = [np.zeros(len(numbers), dtype=np.int64) for _ in STATISTICS]
        if not self.pairs:
            return out
        width = -(-(self.vocabulary.words + 2) // self.ranges)
        target = numbers // width
        for number in np.unique(target[numbers >= 0]).tolist():
            own = np.flatnonzero(target == number)
            for values, known in zip(out, statistic_parts(self.vocabulary.folder, number), strict=True):
                if len(known):
                    values[own] = known[numbers[own] - number * width]
        return out

    def after(self, level: Runs, numbers: np.ndarray) -> list[np.ndarray]:
        """Total and numbers of counts 1, 2 and more after contexts that are runs of a level; 0 for -1."""
        out = [np.zeros(len(numbers), dtype=np.int64) for _ in range(4)]
        target = np.searchsorted(np.array(level.bounds), numbers, side="right") - 1
        for shard in np.unique(target[numbers >= 0]).tolist():
            own = np.flatnonzero((target == shard) & (numbers >= 0))
            for values, known in zip(out, run_statistics(level.folder, level.order, shard), strict=True):
                if len(known):
                    values[own] = known[numbers[own] - level.bounds[shard]]
        return out

    def long_log_probabilities(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The same as ``log_probabilities`` by all levels, for the tokens of texts with these bounds."""
        words, word = np.unique(tokens, return_inverse=True)
        found = self.statistics(words)[-1]
        lower = self.word_rest / (self.vocabulary.distinct + 1) + discounted(found, self.word_discounts) / max(self.pairs, 1)
        likely = lower[word]
        for number, (before, _, counts) in enumerate(chain(tokens, first, self.vocabulary, list(self.levels))):
            given, place = np.unique(before, return_inverse=True)
            total, *often = self.after(self.levels[number - 1], given) if number else self.statistics(given)[:4]
            by = self.level_discounts[number]
            rest = sum(own * share for own, share in zip(often, by, strict=True))
            total, rest = total[place], rest[place]
            likely = np.where(total > 0, (discounted(counts, by) + rest * likely) / np.maximum(total, 1), likely)
        return np.log10(likely)

    def log_probabilities(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Base-10 logarithms of the probabilities of tokens after contexts; -1 is unknown."""
        numbers, where = np.unique(np.concatenate([before, tokens]), return_inverse=True)
        total, ones, twos, more, contexts_before = self.statistics(numbers)
        context, word = where[: len(before)], where[len(before) :]
        lower = self.word_rest / (self.vocabulary.distinct + 1) + discounted(contexts_before, self.word_discounts) / max(self.pairs, 1)
        rest = ones * self.pair_discounts[0] + twos * self.pair_discounts[1] + more * self.pair_discounts[2]
        known = (before >= 0) & (tokens >= 0)
        keys, place = np.unique(pair_keys(before[known], tokens[known]), return_inverse=True)
        count = np.zeros(len(tokens))
        count[known] = discounted(self.pair_counts(keys), self.pair_discounts)[place]
        times = total[context]
        upper = (count + rest[context] * lower[word]) / np.maximum(times, 1)
        return np.log10(np.where(times > 0, upper, lower[word]))


def discounted(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *by])[np.minimum(counts, 3)], 0)


@lru_cache(maxsize=MAPPED_SHARDS)
def pair_part(folder: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
    pairs, counts = f"{folder}/pairs-{shard}", f"{folder}/pair-counts-{shard}"
    return (mapped(pairs, "<u8"), mapped(counts, "<i8")) if os.path.exists(counts) else NO_PART


@lru_cache(maxsize=4096)
def statistic_parts(folder: str, number: int) -> list[np.ndarray]:
    if not os.path.exists(f"{folder}/{STATISTICS[-1]}-{number}"):
        return [np.zeros(0, dtype="<i8")] * len(STATISTICS)
    return [mapped(f"{folder}/{name}-{number}", "<i8") for name in STATISTICS]


def train(texts: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Counts all texts and writes the model's arrays to a new folder under the shared one."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = texts.sparkSession
    folder = mounted_folder(spark, "language-model")
    rows = texts.select(F.col(f"`{text}`").alias("text"))
    vocabulary = count_words(rows, folder)
    numbers = vocabulary.words + 2
    if numbers > 1 << 32:
        raise ValueError(f"more than {1 << 32:,} words: their numbers don't fit into the keys of pairs")
    shards = max(2 * shuffle_partitions(spark), vocabulary.tokens // SHARD_TOKENS)
    ranges = min(numbers, max(shuffle_partitions(spark), numbers // RANGE_WORDS))
    packed = "target bigint, piece binary"
    if order > 2:
        return train_runs(rows, vocabulary, order, shards, ranges)
    pairs = rows.mapInArrow(count_pairs(vocabulary, shards), packed)
    merged = written(by_shard(pairs, shards).groupBy("target").applyInArrow(write_pairs(folder, ranges, numbers), packed), "statistics")
    counted = added(merged.where("target < 0"), 5)
    ranged = merged.where("target >= 0").groupBy("target").applyInArrow(write_statistics(folder, ranges, numbers), "piece binary")
    before = added(ranged, 6)[1:]
    word_discounts = discounts(before[1:])
    often = np.array([before[1], before[2], before[0] - before[1] - before[2]])
    total = int(counted[0])
    rest = float(often @ np.array(word_discounts) / total) if total else 1.0
    return Model(vocabulary, shards, ranges, total, discounts(counted[1:]), word_discounts, rest)


def by_shard(rows: DataFrame, shards: int) -> DataFrame:
    """The rows by ``target`` in half as many tasks as there are shards, so that a task's rows don't grow with the corpus."""
    return rows.repartition(max(shuffle_partitions(rows.sparkSession), shards // 2), "target")


def train_runs(rows: DataFrame, vocabulary: Vocabulary, order: int, shards: int, ranges: int) -> Model:
    """The model of runs of up to ``order`` tokens: counted from the shortest runs up, settled from the longest down."""
    spark, folder, numbers = rows.sparkSession, vocabulary.folder, vocabulary.words + 2
    packed, levels = "target bigint, piece binary", []
    for size in range(2, order + 1):
        counted = rows.mapInArrow(count_runs(vocabulary, list(levels), shards), packed)
        by_shard(counted, shards).groupBy("target").applyInArrow(write_runs(folder, size), packed).count()
        levels.append(written_runs(folder, size, shards))
    handed, found = None, []
    for place in reversed(range(len(levels))):
        level = levels[place]
        own = [(n, b"") for n in range(shards) if level.bounds[n] < level.bounds[n + 1]]
        given = spark.createDataFrame(own, packed)
        given = given if handed is None else given.union(handed)
        width = -(-numbers // ranges)
        below = levels[place - 1].bounds if place else tuple(width * n for n in range(ranges + 1))
        settle = settle_runs(level, handed is None, below)
        settled = written(given.groupBy("target").applyInArrow(settle, packed), f"settled-{level.order}")
        found.append(added(settled.where("target < 0"), 5))
        handed = settled.where("target >= 0")
    before = added(handed.groupBy("target").applyInArrow(write_statistics(folder, ranges, numbers), "piece binary"), 6)[1:]
    by, word_discounts = [discounts(counts[1:]) for counts in reversed(found)], discounts(before[1:])
    often = np.array([before[1], before[2], before[0] - before[1] - before[2]])
    total = levels[0].number
    rest = float(often @ np.array(word_discounts) / total) if total else 1.0
    settled = tuple(Runs(folder, level.order, level.bounds, "settled") for level in levels)
    return Model(vocabulary, shards, ranges, total, by[0], word_discounts, rest, settled, tuple(by))


def added(rows: DataFrame, width: int) -> np.ndarray:
    """The sum of rows of ``width`` packed numbers: one row for each task, added up in tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            for piece in batch.column("piece"):
                total += np.frombuffer(piece.as_py(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["sums"])

    sums = rows.select("piece").mapInArrow(add, "sums array<bigint>")
    found = sums.select(*[F.sum(F.get("sums", F.lit(n))).alias(f"s{n}") for n in range(width)]).first()
    return np.array([value or 0 for value in found], dtype=np.int64)


def score(documents: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each document as ``row`` beside ``n_tokens``, ``n_known``, ``base_score`` and ``score``, base-10 logarithms.

    ``keep`` names the columns of ``row``, all by default.
    """
    vocabulary = model.vocabulary
    below = vocabulary.tokens + UNKNOWN_COUNT * (vocabulary.distinct + 1)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                tokens, counts, first = numbered(part.column("text"), vocabulary)
                heads = first[:-1]
                if model.levels:
                    found = model.long_log_probabilities(tokens, first)
                else:
                    found = model.log_probabilities(contexts(tokens, first, vocabulary.start), tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        pa.array(np.diff(first)),
                        pa.array(np.add.reduceat((counts > 0).astype(np.int64), heads)),
                        pa.array(np.add.reduceat(np.log10((counts + UNKNOWN_COUNT) / below), heads)),
                        pa.array(np.add.reduceat(found, heads)),
                    ],
                    names=["row", "n_tokens", "n_known", "base_score", "score"],
                )

    frame = whole_rows(documents, keep, text=text)
    kinds = [F.lit(None).cast(kind).alias(name) for name, kind in (column.split() for column in RESULT.split(", "))]
    return frame.mapInArrow(rate, frame.select("row", *kinds).schema)
