"""Quality of documents by the votes of their nearest labelled neighbours in a latent semantic space.

A text is described by three histograms: its pairs of bytes, hashed; its runs of three character classes; and the shares of
words that do and don't repeat the word before. Square roots of shares make texts of all lengths comparable. The leading
directions of the labelled texts' histograms span the latent space, found by subspace iteration. Each document is compared
with all labelled vectors by blocked cosine products, without an index, and the ``k`` most similar vote on its label, each
with the weight of its similarity to the power ``sharpness``.

At most ``most_labelled`` labelled documents are learnt from, those with the smallest hashes of their ids; this bounds what
the driver and the broadcast hold: that many times ``WIDTH`` numbers, and that many vectors of ``rank`` numbers. All other
work goes over all documents.

Null texts are empty texts. Labels without an id or a value are left out, as are those of unknown documents. With no
labels at all every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import words as W
from tallyline.llm.frames import whole_rows

MOST_LABELLED = 4000
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 8
PAIRS = 1024
SLICE_BYTES = 1 << 20
DOCUMENTS = 512
CLASSES = 12
WIDTH = PAIRS + CLASSES**3 + 2


def byte_classes() -> np.ndarray:
    """Lower case, upper case, digits, spaces, line ends, stops, marks of symbols and others, beyond ASCII."""
    table = np.zeros(256, dtype=np.int64)
    for number, letters in enumerate(("", "0123456789", " \t", "\n\r\v\f", ".,;:", "!?", "'\"()-", "#*$%&", "|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 1):
        table[[ord(c) for c in letters]] = number
    table[[b for b in range(128) if not chr(b).isalnum() and table[b] == 0]] = 1
    table[128:] = 11
    return table


BYTE_CLASSES = byte_classes()


def shares(codes: np.ndarray, owner: np.ndarray, texts: int, width: int) -> np.ndarray:
    counts = np.bincount(owner * width + codes, minlength=texts * width).reshape(texts, width).astype(np.float32)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def described(column: pa.Array) -> np.ndarray:
    """A row of ``WIDTH`` numbers for each text."""
    data, places = W.text_bytes(column)
    texts = len(places) - 1
    owner = np.repeat(np.arange(texts), np.diff(places))
    wide = data.astype(np.int64)
    pair = np.flatnonzero(owner[:-1] == owner[1:]) if len(data) > 1 else np.zeros(0, dtype=np.int64)
    pairs = shares((wide[pair] * 251 + wide[pair + 1] * 1031) % PAIRS, owner[pair], texts, PAIRS)
    kinds = BYTE_CLASSES[data]
    run = np.flatnonzero(owner[:-2] == owner[2:]) if len(data) > 2 else np.zeros(0, dtype=np.int64)
    runs = shares((kinds[run] * CLASSES + kinds[run + 1]) * CLASSES + kinds[run + 2], owner[run], texts, CLASSES**3)
    split = W.split(column, W.NOT_SPACES, lower=False)
    values, text = W.hashes(split), split.text_of_word
    again = np.zeros(len(values), dtype=np.int64)
    again[1:] = (values[1:] == values[:-1]) & (text[1:] == text[:-1])
    repeats = shares(again, text, texts, 2)
    repeats[split.counts == 0, 0] = 1
    return np.hstack([pairs, runs, repeats])


@dataclass(frozen=True)
class Space:
    """The labelled vectors of a latent space."""

    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, rows: np.ndarray) -> np.ndarray:
        found = rows @ self.directions
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)

    def scores(self, rows: np.ndarray, k: int, sharpness: int) -> np.ndarray:
        """Weighted votes for label 1, from 0 to 1."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        near = self.project(rows) @ self.vectors.T
        k = min(k, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(near, best, axis=1).astype(np.float64), 0) ** sharpness + 1e-9
        return np.clip((weights * self.labels[best]).sum(axis=1) / weights.sum(axis=1), 0, 1)


def learn(rows: np.ndarray, labels: np.ndarray, rank: int, rounds: int = 6) -> Space:
    """Leading right singular directions of the rows by subspace iteration, and the rows in them."""
    rank = min(rank, *rows.shape) if len(rows) else 1
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((rows.shape[1], rank)))[0].astype(np.float32)
    for _ in range(rounds if len(rows) else 0):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    space = Space(basis, np.zeros((0, rank), dtype=np.float32), labels)
    return Space(basis, space.project(rows).astype(np.float32), labels) if len(rows) else space


def labelled_rows(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Described texts and labels of the learnt documents, in the order of their ids."""
    chosen = (
        labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("double").alias("label"))
        .dropna()
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )
    texts = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                rows = described(part.column("text")).astype("<f4")
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), pa.array([row.tobytes() for row in rows], pa.binary())],
                    names=["id", "label", "row"],
                )

    found = texts.join(F.broadcast(chosen), "id").mapInArrow(describe, "id bigint, label double, row binary")
    table = found.groupBy("id").agg(F.min("label").alias("label"), F.min("row").alias("row")).orderBy("id").toArrow()
    rows = [np.frombuffer(row.as_py(), "<f4") for row in table.column("row")]
    return np.array(rows, dtype=np.float32).reshape(-1, WIDTH), table.column("label").to_numpy()


def score(
    documents: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    most_labelled: int = MOST_LABELLED,
    rank: int = RANK,
    k: int = NEIGHBOURS,
    sharpness: int = SHARPNESS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Each document as ``row`` beside its ``score``, from 0 to 1: higher where label 1 is likelier.

    ``keep`` names the columns of ``row``, all by default.
    """
    space = learn(*labelled_rows(documents, labels, doc_id, text, label, most_labelled), rank)
    known = documents.sparkSession.sparkContext.broadcast(space)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.slices(batch, "text", SLICE_BYTES):
                for start in range(0, piece.num_rows, DOCUMENTS):
                    part = piece.slice(start, DOCUMENTS)
                    found = known.value.scores(described(part.column("text")), k, sharpness)
                    yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found)], names=["row", "score"])

    frame = whole_rows(documents, keep, text=text)
    return frame.mapInArrow(vote, frame.select("row", F.lit(0.0).alias("score")).schema)
