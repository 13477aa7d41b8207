"""Removal of passages that repeat across documents, window by window, by super-k-mers.

A window is ``window`` consecutive words. Its minimiser is the smallest hash among its grams of ``gram`` words, so equal
windows have equal minimisers. Consecutive windows that share a minimiser travel as one packed string, their words joined
by a space, to the bucket of the minimiser. There all windows are sorted by hash and compared word by word, which gives
the smallest doc_id of each distinct window. A word is removed if it is covered by a window that also starts in a document
with a smaller doc_id.

Three things keep that in bounds.
- Only strings whose minimiser stands in at least two documents travel. Which those are is counted first and handed to the
  tasks as a bit map of ``filter_bits`` bits, a fixed size; a false hit there costs a string and changes nothing.
- Equal strings are combined before they travel to a bucket, with their smallest and largest doc_id. The answer for a
  string is joined back to the places it stands in, and that join can be split.
- The strings of a minimiser that more than ``crowd`` different strings share, such as a common phrase in many contexts,
  are cut into single windows, which are grouped by a 128-bit hash of their words.

Null texts have no words. A document without a doc_id keeps all its words and removes none elsewhere. Rows that repeat a
doc_id count as one document, which removes nothing from itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import words as W
from tallyline.llm.frames import joined, shuffle_partitions, whole_rows, written
from tallyline.llm.near_dedup import compact

WINDOW = 50
GRAM = 16
FILTER_BITS = 1 << 27
MOST_WINDOWS = 512
CROWD = 2000
BLOCK_WINDOWS = 1 << 13
BUCKET_BYTES = 8 << 20
BROADCAST_ROWS = 1_000_000
SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
RESULT = pa.struct([("n_words", pa.int64()), ("spans", SPANS), ("kept", pa.string())])
SQL_RESULT = "struct<n_words:bigint,spans:array<struct<begin:bigint,end:bigint>>,kept:string>"
SECOND = np.uint64(0x2545F4914F6CDD1D)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    runs = len(values) - width + 1
    if runs <= 0:
        return values[:0]
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[:runs], values[width - reach : width - reach + runs])


def runs_of_windows(split: W.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, end of windows and minimiser of each run of windows that share one."""
    values = W.hashes(split)
    least = sliding_minimum(W.grams(values, gram), window - gram + 1)
    text = split.text_of_word
    inside = np.flatnonzero(text[: len(least)] == text[window - 1 : window - 1 + len(least)])
    if not len(inside):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64)
    value, owner = least[inside], text[inside]
    opens = np.ones(len(inside), dtype=bool)
    opens[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(opens)
    lengths = np.diff(np.append(heads, len(inside)))
    parts = -(-lengths // MOST_WINDOWS)
    if parts.max() > 1:
        within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.repeat(heads + lengths, parts)
        heads = np.repeat(heads, parts) + within * MOST_WINDOWS
        lengths = np.minimum(ends - heads, MOST_WINDOWS)
    first = inside[heads]
    return owner[heads], first, first + lengths, value[heads]


def minimisers(window: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                split = W.split(part.column("text"), W.NOT_SPACES, lower=False)
                text, _, _, value = runs_of_windows(split, window, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), part.column("doc_id").take(pa.array(text))], names=["mini", "doc_id"]
                )

    return find


def bit_map(minis: DataFrame, bits: int) -> np.ndarray:
    """A bit map of the minimisers: at most ``bits // 64`` numbers, whatever the input."""
    place = F.pmod(F.col("mini"), F.lit(bits))
    rows = minis.groupBy(F.shiftright(place, 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(mini, 64) as int))")).alias("bits")
    )
    found = np.zeros(bits // 64, dtype=np.uint64)
    for batch in rows.toArrow().to_batches():
        found[batch.column("at").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    return found


def strings(window: int, gram: int, filter_bits: int, kept):
    """The packed strings whose minimiser is in the bit map, with their places."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept.value
        for batch in batches:
            for part in W.slices(batch, "text"):
                split = W.split(part.column("text"), W.NOT_SPACES, lower=False)
                text, first, last, value = runs_of_windows(split, window, gram)
                place = np.mod(value.view(np.int64), filter_bits).astype(np.uint64)
                hit = (known[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                text, first, last, value = text[hit], first[hit], last[hit], value[hit]
                data, begin, end = compact(split)
                spans = zip(begin[first].tolist(), end[last + window - 2].tolist(), strict=True) if len(first) else ()
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(value.view(np.int64)),
                        pa.array([data[a:b] for a, b in spans], pa.binary()),
                        part.column("doc_id").take(rows),
                        part.column("text_key").take(rows),
                        pa.array(first - split.first[text], pa.int64()),
                    ],
                    names=["mini", "body", "doc_id", "text_key", "start"],
                )

    return pack


def windows_of(bodies: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and first word and body of all windows of the bodies."""
    split = W.split(bodies.cast(pa.large_string()), W.NOT_SPACES, lower=False)
    values = W.hashes(split)
    counts = np.maximum(split.counts - window + 1, 0)
    body = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(body)) - np.repeat(np.cumsum(counts) - counts - split.first[:-1], counts)
    return values, first, body


def sorted_classes(values: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """A number for each window, equal for exactly those with equal words.

    Windows are sorted by one hash of their words, and neighbours with equal hashes are compared word by word. Should two
    of them differ, all are sorted anew by the words themselves.
    """
    hashed = W.grams(values, window)[first]
    order = np.argsort(hashed, kind="stable")
    same = np.zeros(len(order), dtype=bool)
    same[1:] = hashed[order[1:]] == hashed[order[:-1]]
    if not same_words(values, first, order, np.flatnonzero(same), window).all():
        order = np.lexsort([values[first + place] for place in range(window)])
        same[1:] = same_words(values, first, order, np.arange(1, len(order)), window)
    classes = np.empty(len(order), dtype=np.int64)
    classes[order] = np.cumsum(~same) - 1
    return classes


def same_words(values: np.ndarray, first: np.ndarray, order: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows at these places of the order have the words of the ones before them."""
    same = np.ones(len(places), dtype=bool)
    offsets = np.arange(window)
    for start in range(0, len(places), BLOCK_WINDOWS):
        part = slice(start, start + BLOCK_WINDOWS)
        own, before = first[order[places[part]]], first[order[places[part] - 1]]
        same[part] = (values[own[:, None] + offsets] == values[before[:, None] + offsets]).all(axis=1)
    return same


def bucket_answers(window: int):
    def answer(table: pa.Table) -> pa.Table:
        """For each string with something to remove: the smallest doc_id of each of its windows."""
        bodies = table.column("body").combine_chunks()
        low = table.column("low").to_numpy()
        high = table.column("high").to_numpy()
        values, first, body = windows_of(bodies, window)
        classes = sorted_classes(values, first, window)
        least = np.full(int(classes.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, classes, low[body])
        least = least[classes]
        counts = np.bincount(body, minlength=len(low))
        ends = np.cumsum(counts)
        useful = np.flatnonzero(np.bincount(body, least < high[body], minlength=len(low)) > 0)
        return pa.table(
            {
                "body": bodies.take(pa.array(useful)),
                "least": pa.array([least[ends[n] - counts[n] : ends[n]] for n in useful.tolist()], pa.list_(pa.int64())),
            }
        )

    return answer


def single_windows(window: int):
    """Windows of crowded strings as 128-bit hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(n, 1024) for n in range(0, batch.num_rows, 1024)):
                values, first, body = windows_of(part.column("body"), window)
                own = pa.array(body)
                start = np.flatnonzero(np.diff(body, prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(W.grams(values, window)[first].view(np.int64)),
                        pa.array(W.grams(W.mix(values * SECOND), window)[first].view(np.int64)),
                        part.column("body_key").take(own),
                        pa.array(np.arange(len(body)) - np.repeat(start, np.diff(np.append(start, len(body))))),
                        part.column("low").take(own),
                        part.column("high").take(own),
                    ],
                    names=["one", "two", "body_key", "nth", "low", "high"],
                )

    return cut


def body_key(body) -> F.Column:
    return F.unhex(F.md5(body))


def answers(bodies: DataFrame, window: int, crowd: int) -> DataFrame:
    """``body_key`` and ``least``, the smallest doc_id of each window, of the strings from which something goes."""
    spark = bodies.sparkSession
    crowded = written(bodies.groupBy("mini").count().where(F.col("count") > crowd).select("mini"), "crowded")
    size = bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(4 * shuffle_partitions(spark), size // BUCKET_BYTES)
    usual = (
        joined(bodies, crowded, "mini", "left_anti", BROADCAST_ROWS)
        .select(F.pmod(F.xxhash64("mini"), F.lit(buckets)).alias("bucket"), "body", "low", "high")
        .groupBy("bucket")
        .applyInArrow(bucket_answers(window), "body binary, least array<bigint>")
        .select(body_key("body").alias("body_key"), "least")
    )
    if crowded.isEmpty():
        return usual
    many = joined(bodies, crowded, "mini", "left_semi", BROADCAST_ROWS).withColumn("body_key", body_key("body"))
    cut = written(
        many.select("body", "body_key", "low", "high").mapInArrow(
            single_windows(window), "one bigint, two bigint, body_key binary, nth bigint, low bigint, high bigint"
        ),
        "windows",
    )
    least = cut.groupBy("one", "two").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most")
    least = written(least.drop("most"), "least")
    found = cut.join(least, ["one", "two"]).where("least < high").select("body_key", F.struct("nth", "least").alias("hit"))
    last = found.groupBy("body_key").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    none = F.lit(np.iinfo(np.int64).max)
    filled = F.transform(
        F.sequence(F.lit(0).cast("long"), F.element_at("hits", -1)["nth"]),
        lambda nth: F.coalesce(F.try_element_at(F.map_from_entries("hits"), nth), none),
    )
    return usual.union(last.select("body_key", filled.alias("least")))


def removed_spans(places: DataFrame, least: DataFrame, window: int) -> DataFrame:
    """Merged word spans to remove by (doc_id, text_key)."""
    hits = places.join(least, "body_key").select(
        "doc_id",
        "text_key",
        F.filter(
            F.transform(
                "least", lambda low, nth: F.when(low < F.col("doc_id"), F.col("start") + nth)
            ),
            lambda start: start.isNotNull(),
        ).alias("starts"),
    )
    gathered = (
        hits.where(F.size("starts") > 0)
        .groupBy("doc_id", "text_key")
        .agg(F.flatten(F.collect_set("starts")).alias("starts"))
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(n, 500) for n in range(0, batch.num_rows, 500)):
                spans = [covered(starts, window) for starts in part.column("starts").to_pylist()]
                rows = [[{"begin": begin, "end": end} for begin, end in own] for own in spans]
                columns = [part.column("doc_id"), part.column("text_key"), pa.array(rows, SPANS)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "spans"])

    return gathered.mapInArrow(merge, "doc_id bigint, text_key bigint, spans array<struct<begin:bigint,end:bigint>>")


def covered(starts: list[int], window: int) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for start in sorted(set(starts)):
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], start + window)
        else:
            spans.append((start, start + window))
    return spans


def remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text"):
            rows = []
            texts = part.column("text").cast(pa.large_binary())
            for text, spans in zip(texts, part.column("spans").to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                kept, done = [], 0
                for span in spans or ():
                    kept += words[done : span["begin"]]
                    done = span["end"]
                kept = kept + words[done:] if spans else words
                rows.append({"n_words": len(words), "spans": spans or [], "kept": b" ".join(kept).decode()})
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(rows, RESULT)], names=["row", "found"])


def remove_repeats(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    filter_bits: int = FILTER_BITS,
    crowd: int = CROWD,
    keep: list[str] | None = None,
) -> DataFrame:
    """Each document as ``row`` beside ``found``: ``n_words``, the removed word ``spans`` and the ``kept`` text.

    ``keep`` names the columns of ``row``, all by default.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be from 1 to window")
    spark: SparkSession = documents.sparkSession
    frame = whole_rows(documents, keep, doc_id=doc_id, text=text).withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "text_key": F.xxhash64("text")}
    )
    owned = frame.where("doc_id is not null")
    minis = owned.select("doc_id", "text").mapInArrow(minimisers(window, gram), "mini bigint, doc_id bigint")
    shared = minis.groupBy("mini").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    kept = spark.sparkContext.broadcast(bit_map(shared, filter_bits))
    packed = written(
        owned.select("doc_id", "text_key", "text").mapInArrow(
            strings(window, gram, filter_bits, kept),
            "mini bigint, body binary, doc_id bigint, text_key bigint, start bigint",
        ),
        "strings",
    )
    bodies = written(packed.groupBy("mini", "body").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "bodies")
    least = written(answers(bodies, window, crowd), "answers")
    places = packed.select(body_key("body").alias("body_key"), "doc_id", "text_key", "start")
    spans = written(removed_spans(places, least, window), "spans")
    both = (frame["doc_id"] == spans["doc_id"]) & (frame["text_key"] == spans["text_key"])
    wanted = joined(frame, spans, both, "left", BROADCAST_ROWS, F.size("spans")).select("row", "text", "spans")
    schema = wanted.select("row", F.lit(None).cast(SQL_RESULT).alias("found")).schema
    return wanted.mapInArrow(remover, schema)
