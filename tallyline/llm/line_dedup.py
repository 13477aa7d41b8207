"""Removal of lines that repeat, or nearly repeat, an earlier line, by a join of deletion neighbourhoods.

A line's words are what stands between white space, with A-Z in lower case. Every line with a word is judged. A line is
removed if an earlier line (smaller doc_id, or same document and smaller line number) is equal or near, whether or not that
one is removed itself. Two lines are near if both have ``min_words`` words or more and at most one word was put in, left out
or exchanged; with 5, one word is at most a fifth of a line. Shorter lines are removed if an earlier line is equal.
``equal_words`` leaves out lines of fewer words altogether; it is 1 unless given.

Each line emits the hashes of its words without each one of them. Lines with equal hashes, and with the word left out at
the same place, are near by an exchange; a line whose own hash equals such a hash is near by a word put in. Only the
earliest line of equal keys is joined to the others, so no pairs within a group are made, and the distance of what is
joined is verified on the words.

Neighbourhoods are large, so only what can have a partner is emitted. One edit leaves the first or the second half of a
line as it was. The halves of all lines, cut as for the line's own length and as for one word less, and the whole lines
are counted first; the keys that two lines at different places, or two different lines' halves, share are handed to the
tasks as a bit map of a fixed size. A line whose first half is shared leaves out words of its second half only, and the
other way round. The hashes of what is left are counted in the same way, before those that two lines share are emitted with
what belongs to them. A false hit in a bit map costs work and changes nothing.

Null texts have no lines. Documents without a doc_id keep all lines and remove none elsewhere. Rows that repeat a doc_id
and a text are the same document; lines at the same place of different texts with one doc_id don't remove each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import words as W
from tallyline.llm.frames import joined, whole_rows, written
from tallyline.llm.substring_dedup import bit_map

MIN_WORDS = 5
FILTER_BITS = 1 << 27
BROADCAST_ROWS = 1_000_000
KEYS = "mini bigint, value bigint"
LINES = "id binary, line binary, halves int, doc_id bigint, text_key bigint, place int"
VARIANTS = "key binary, nth int, id binary, doc_id bigint, place int"
RESULT = pa.struct([("n_lines", pa.int64()), ("removed", pa.list_(pa.int32())), ("kept", pa.string())])
SQL_RESULT = "struct<n_lines:bigint,removed:array<int>,kept:string>"


def lines_of(text: bytes, min_words: int) -> Iterator[tuple[int, list[bytes]]]:
    """Number and words of each line that is judged."""
    for place, line in enumerate(text.lower().split(b"\n")):
        words = line.split()
        if len(words) >= min_words:
            yield place, words


def half_keys(words: list[bytes]) -> Iterator[int]:
    """Keys of which two lines share one if they are equal or one edit apart."""
    for size in (len(words), len(words) - 1):
        half = size // 2
        tag = b"%d " % size
        yield xxhash.xxh3_64_intdigest(tag + b"< " + b" ".join(words[:half]))
        yield xxhash.xxh3_64_intdigest(tag + b"> " + b" ".join(words[len(words) - (size - half) :]))


def left_out(size: int, halves: int) -> Iterator[int]:
    """Places of words to leave out of a line, by which of its four half keys are shared."""
    places: set[int] = set()
    for number, length in enumerate((size, size - 1)):
        half = length // 2
        if halves >> 2 * number & 1:
            places.update(range(half, size))
        if halves >> 2 * number & 2:
            places.update(range(half + number))
    yield from sorted(places)


def tester(known: np.ndarray, bits: int):
    """Whether a 64-bit key is in a bit map."""

    def hit(key: int) -> bool:
        place = (key if key < 1 << 63 else key - (1 << 64)) % bits
        return bool(int(known[place >> 6]) >> (place & 63) & 1)

    return hit


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    for ident, key, text in zip(batch.column("doc_id"), batch.column("text_key"), batch.column("text").cast(pa.large_binary()), strict=True):
        yield ident.as_py(), key.as_py(), text.as_py() or b""


def counted_keys(min_words: int, equal_words: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                keys, values = [], []
                for ident, _, text in texts(part):
                    for place, words in lines_of(text, equal_words):
                        whole = xxhash.xxh3_64_intdigest(b" ".join(words))
                        halves = list(half_keys(words)) if len(words) >= min_words else []
                        keys += [whole, *halves]
                        values += [xxhash.xxh3_64_intdigest(b"%d %d" % (ident, place)), *[whole] * len(halves)]
                yield pa.RecordBatch.from_arrays([signed(keys), signed(values)], names=["mini", "value"])

    return emit


def possible_lines(min_words: int, equal_words: int, bits: int, shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = tester(shared.value, bits)
        for batch in batches:
            for part in W.slices(batch, "text"):
                rows = []
                for ident, key, text in texts(part):
                    for place, words in lines_of(text, equal_words):
                        whole = b" ".join(words)
                        halves = sum(hit(half) << n for n, half in enumerate(half_keys(words))) if len(words) >= min_words else 0
                        if halves or hit(xxhash.xxh3_64_intdigest(whole)):
                            rows.append((xxhash.xxh3_128_digest(whole), whole, halves, ident, key, place))
                columns = zip(*rows, strict=True) if rows else ((), (), (), (), (), ())
                kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)],
                    names=["id", "line", "halves", "doc_id", "text_key", "place"],
                )

    return find


def variants(line: bytes, halves: int) -> Iterator[tuple[int, bytes]]:
    """The line, as place -1, and the line without each word that is to be left out."""
    words = line.split(b" ")
    yield -1, line
    for n in left_out(len(words), halves):
        yield n, b" ".join(words[:n] + words[n + 1 :])


def variant_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            keys, values = [], []
            for row in batch.slice(start, 2000).to_pylist():
                found = [xxhash.xxh3_64_intdigest(left) for _, left in variants(row["line"], row["halves"])]
                keys += found
                values += [int.from_bytes(row["id"][:8], "little")] * len(found)
            yield pa.RecordBatch.from_arrays([signed(keys), signed(values)], names=["mini", "value"])


def neighbourhoods(shared, bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The keys of a line (``nth`` -1) and of the line without its ``nth`` word that another line may share."""
        hit = tester(shared.value, bits)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                keys, places, owners = [], [], []
                for row, line in enumerate(part.select(["line", "halves"]).to_pylist()):
                    for nth, left in variants(line["line"], line["halves"]):
                        if hit(xxhash.xxh3_64_intdigest(left)):
                            keys.append(xxhash.xxh3_128_digest(left))
                            places.append(nth)
                            owners.append(row)
                own = pa.array(owners, pa.int64())
                taken = [part.column(name).take(own) for name in ("id", "doc_id", "place")]
                columns = [pa.array(keys, pa.binary()), pa.array(places, pa.int32()), *taken]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "nth", "id", "doc_id", "place"])

    return emit


def one_edit(a: F.Column, b: F.Column) -> F.Column:
    """Whether two arrays of words are equal but for at most one word put in, left out or exchanged."""
    shared = F.least(F.size(a), F.size(b))
    steps = F.sequence(F.lit(0), shared - 1)
    ahead = F.coalesce(F.array_min(F.filter(steps, lambda n: F.get(a, n) != F.get(b, n))), shared)
    behind = F.coalesce(
        F.array_min(F.filter(steps, lambda n: F.get(a, F.size(a) - 1 - n) != F.get(b, F.size(b) - 1 - n))), shared
    )
    return F.greatest(F.size(a), F.size(b)) - 1 <= ahead + behind


def earliest(lines: DataFrame, filter_bits: int) -> DataFrame:
    """``id`` of each line that has an equal or near line before it, and the ``first`` of their places."""
    keys = lines.select("id", "line", "halves").mapInArrow(variant_keys, KEYS)
    shared = keys.groupBy("mini").agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low <> high")
    known = lines.sparkSession.sparkContext.broadcast(bit_map(shared, filter_bits))
    emitted = lines.select("id", "line", "halves", "at.*").mapInArrow(neighbourhoods(known, filter_bits), VARIANTS)
    rows = written(emitted, "neighbourhoods")
    place = F.struct("doc_id", "place", "id")
    least = written(rows.groupBy("key", "nth").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")), "least")
    around = least.groupBy("key").agg(
        F.min(F.when(F.col("nth") < 0, F.col("least"))).alias("whole"),
        F.min(F.when(F.col("nth") >= 0, F.col("least"))).alias("lacking"),
        F.sum("n").alias("all"),
    )
    around = written(around.where("all > 1").drop("all"), "around")
    beside = rows.join(least.where("n > 1").drop("n"), ["key", "nth"]).select(place.alias("own"), F.col("least").alias("other"))
    other = F.when(F.col("nth") < 0, F.col("lacking")).otherwise(F.col("whole"))
    across = rows.join(around, "key").select(place.alias("own"), other.alias("other"))
    pairs = (
        beside.union(across)
        .where(F.struct("other.doc_id", "other.place") < F.struct("own.doc_id", "own.place"))
        .select("own.id", F.col("other.id").alias("other_id"))
        .distinct()
    )
    near = (
        pairs.join(lines.select("id", F.col("line").alias("own")), "id")
        .join(lines.select(F.col("id").alias("other_id"), F.col("line").alias("other"), F.col("at").alias("to")), "other_id")
        .where(one_edit(F.split(F.col("own").cast("string"), " "), F.split(F.col("other").cast("string"), " ")))
    )
    return near.groupBy("id").agg(F.min("to").alias("first"))


def remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text"):
            rows = []
            for text, removed in zip(part.column("text").to_pylist(), part.column("places").to_pylist(), strict=True):
                parts = [] if text is None else text.split("\n")
                gone = set(removed or ())
                kept = text if not gone else "\n".join(line for n, line in enumerate(parts) if n not in gone)
                rows.append({"n_lines": len(parts), "removed": sorted(gone), "kept": kept})
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(rows, RESULT)], names=["row", "found"])


def remove_lines(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    filter_bits: int = FILTER_BITS,
    equal_words: int = 1,
    keep: list[str] | None = None,
) -> DataFrame:
    """Each document as ``row`` beside ``found``: ``n_lines``, the numbers of ``removed`` lines and the ``kept`` text.

    ``keep`` names the columns of ``row``, all by default.
    """
    if min_words < 3:
        raise ValueError("lines of fewer than three words are all near each other")
    if not 1 <= equal_words <= min_words:
        raise ValueError("equal_words must be from 1 to min_words")
    spark = documents.sparkSession
    frame = whole_rows(documents, keep, doc_id=doc_id, text=text).withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "text_key": F.xxhash64("text")}
    )
    owned = frame.where("doc_id is not null and text is not null").select("doc_id", "text_key", "text")
    keys = owned.mapInArrow(counted_keys(min_words, equal_words), KEYS)
    shared = keys.groupBy("mini").agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low <> high")
    known = spark.sparkContext.broadcast(bit_map(shared, filter_bits))
    occurring = written(owned.mapInArrow(possible_lines(min_words, equal_words, filter_bits, known), LINES), "lines")
    lines = written(occurring.groupBy("id", "line", "halves").agg(F.min(F.struct("doc_id", "place")).alias("at")), "distinct-lines")
    near = written(earliest(lines.where("halves > 0"), filter_bits), "near")
    least = lines.join(near, "id", "left").select("id", F.least("at", F.coalesce("first", "at")).alias("first"))
    removed = (
        occurring.select("id", "doc_id", "text_key", "place")
        .join(written(least, "first"), "id")
        .where(F.struct("doc_id", "place") > F.col("first"))
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("place").alias("places"))
    )
    removed = written(removed, "removed")
    both = (frame["doc_id"] == removed["doc_id"]) & (frame["text_key"] == removed["text_key"])
    wanted = joined(frame, removed, both, "left", BROADCAST_ROWS, F.size("places")).select("row", "text", "places")
    schema = wanted.select("row", F.lit(None).cast(SQL_RESULT).alias("found")).schema
    return wanted.mapInArrow(remover, schema)
