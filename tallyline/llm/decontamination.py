"""Words of documents that also stand in benchmark items, found by winnowing.

Both sides are cut into grams of ``gram`` words. Of each run of ``span - gram + 1`` consecutive grams the one with the
smallest hash is kept (the rightmost of equal ones), so two texts that share ``span`` words share a kept gram. Equal
grams are seeds, which are extended along the words of both texts in both directions; runs of ``span`` words or more are
hits. Items with fewer words count as one window; their whole word sequence is the gram, sought at each place.

A benchmark of at most ``block_bytes`` of distinct text, in which no gram stands more than ``MOST_PLACES`` times, is
indexed and broadcast to one narrow pass over the documents. Any other is never fetched: Spark joins the kept grams of
both sides. There a seed carries the windows of ``span`` words around it as 128-bit digests, and seeds of one gram meet
only where a window is equal, so a gram that many texts share doesn't multiply; touching windows are then one hit.
Documents send only seeds whose gram is in the bit map of the benchmark's, never texts, and windows that a large part of
the documents holds are split by adaptive execution, as the smaller side has each window and item once.

Null texts have no words. Repeated items share one entry. An item without an id is used under the id ``""``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm import words as W
from tallyline.llm.frames import ROW, joined, whole_rows, written
from tallyline.llm.substring_dedup import bit_map

GRAM = 5
SPAN = 10
BLOCK_BYTES = 16 << 20
MOST_PLACES = 1000
FILTER_BITS = 1 << 27
EMITTED = 20_000
BROADCAST_ROWS = 1_000_000
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ENTRIES = "name string, entry binary, text string"
WINDOWS = "gram bigint, window binary, size int, entry binary"
HITS = "gram bigint, window binary, text_key binary, places array<int>"
RESULT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)
SQL_RESULT = "struct<n_words:bigint,spans:array<struct<begin:bigint,end:bigint>>,items:array<string>>"


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of each ``width`` consecutive values, the rightmost of equal ones."""
    runs = len(values) - width + 1
    if runs <= 0:
        return np.zeros(0, dtype=np.int64)
    best, place = values[:runs].copy(), np.arange(runs)
    for step in range(1, width):
        other = values[step : step + runs]
        lower = other <= best
        best[lower] = other[lower]
        place[lower] = np.flatnonzero(lower) + step
    return place


def kept_grams(values: np.ndarray, first: np.ndarray, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that winnowing keeps; ``first`` are the bounds of the texts in ``values``."""
    hashed = W.grams(values, gram)
    place = smallest(hashed, span - gram + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = text[: len(place)] == text[span - 1 : span - 1 + len(place)]
    place = place[inside]
    if len(place):
        place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    return place, hashed[place]


@dataclass
class Items:
    """Distinct item texts and where their grams stand."""

    names: list[list[str]]
    words: list[list[bytes]]
    hashes: list[np.ndarray]
    keys: np.ndarray
    places: dict[int, list[tuple[int, int]]]
    short: dict[int, dict[int, list[int]]]


def index_items(rows: list[tuple[str, str]], gram: int, span: int) -> Items:
    split = W.split(pa.array([text for _, text in rows], pa.large_string()), W.LETTERS_AND_DIGITS, lower=True)
    hashed = W.hashes(split)
    entry: dict[tuple[bytes, ...], int] = {}
    items = Items([], [], [], np.zeros(0, dtype=np.uint64), defaultdict(list), defaultdict(lambda: defaultdict(list)))
    for number, (name, _) in enumerate(rows):
        start, stop = split.first[number], split.first[number + 1]
        own = split.words(start, stop)
        if not own:
            continue
        at = entry.setdefault(tuple(own), len(items.words))
        if at < len(items.words):
            items.names[at].append(name)
            continue
        values = hashed[start:stop]
        items.names.append([name])
        items.words.append(own)
        items.hashes.append(values)
        if len(own) < span:
            items.short[len(own)][int(W.grams(values, len(own))[0])].append(at)
        else:
            for place, key in zip(*kept_grams(values, np.array([0, len(own)]), gram, span), strict=True):
                items.places[int(key)].append((at, int(place)))
    items.keys = np.array(sorted(items.places), dtype=np.uint64)
    items.places, items.short = dict(items.places), {size: dict(found) for size, found in items.short.items()}
    return items


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), dtype=bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def extended(text: np.ndarray, item: np.ndarray, at: int, place: int) -> tuple[int, int]:
    """The longest run of equal words around a seed, as a span of the text."""
    back = min(at, place)
    differs = np.flatnonzero(text[at - back : at] != item[place - back : place])
    start = at - back + (int(differs[-1]) + 1 if len(differs) else 0)
    ahead = min(len(text) - at, len(item) - place)
    differs = np.flatnonzero(text[at : at + ahead] != item[place : place + ahead])
    return start, at + (int(differs[0]) if len(differs) else ahead)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def find(split: W.Words, items: Items, gram: int, span: int) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """Hit spans and item names by text."""
    values = W.hashes(split)
    found: dict[int, tuple[list[tuple[int, int]], set[str]]] = defaultdict(lambda: ([], set()))
    first = split.first
    places, keys = kept_grams(values, first, gram, span)
    hit = among(keys, items.keys)
    places, keys = places[hit], keys[hit]
    done: dict[tuple[int, int, int], int] = {}
    for place, key, text in zip(
        places.tolist(), keys.tolist(), (np.searchsorted(first, places, side="right") - 1).tolist(), strict=True
    ):
        low, high = int(first[text]), int(first[text + 1])
        for item, offset in items.places[key]:
            line = (text, item, place - offset)
            if done.get(line, -1) >= place:
                continue
            start, stop = extended(values[low:high], items.hashes[item], place - low, offset)
            done[line] = low + stop
            begin = offset - (place - low - start)
            if stop - start >= span and split.words(low + start, low + stop) == items.words[item][begin : begin + stop - start]:
                found[text][0].append((start, stop))
                found[text][1].update(items.names[item])
    for size, known in items.short.items():
        hashed = W.grams(values, size)
        places = np.flatnonzero(among(hashed, np.array(sorted(known), dtype=np.uint64)))
        texts = np.searchsorted(first, places, side="right") - 1
        for place, text in zip(places.tolist(), texts.tolist(), strict=True):
            if place + size > first[text + 1]:
                continue
            own = split.words(place, place + size)
            for item in known[int(hashed[place])]:
                if items.words[item] == own:
                    found[text][0].append((place - int(first[text]), place - int(first[text]) + size))
                    found[text][1].update(items.names[item])
    return found


def marker(items, gram: int, span: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                split = W.split(part.column("text"), W.LETTERS_AND_DIGITS, lower=True)
                found = find(split, items.value, gram, span)
                rows = []
                for text, count in enumerate(split.counts.tolist()):
                    spans, names = found.get(text, ([], set()))
                    rows.append(
                        {
                            "n_words": count,
                            "spans": [{"begin": begin, "end": end} for begin, end in merged(spans)],
                            "items": sorted(names),
                        }
                    )
                yield pa.RecordBatch.from_arrays([part.column(ROW), pa.array(rows, RESULT)], names=[ROW, "found"])

    return mark


def window_grams(values: np.ndarray, first: np.ndarray, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The start of each window of ``span`` words of one text, and the hash of the gram that winnowing keeps of it."""
    hashed = W.grams(values, gram)
    place = smallest(hashed, span - gram + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(text[: len(place)] == text[span - 1 : span - 1 + len(place)])
    return starts, hashed[place[starts]]


def digest(split: W.Words, start: int, stop: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(split.words(start, stop)))


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item that has words, with a digest of them."""
    for batch in batches:
        for part in W.slices(batch, "text"):
            split = W.split(part.column("text"), W.LETTERS_AND_DIGITS, lower=True)
            filled = np.flatnonzero(split.counts)
            made = [digest(split, split.first[n], split.first[n + 1]) for n in filled]
            own = pa.array(filled)
            columns = [part.column("name").take(own), pa.array(made, pa.binary()), part.column("text").take(own)]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "entry", "text"])


def item_windows(gram: int, span: int):
    """All windows of items, with their kept grams; an item of fewer words is one window and its own gram."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                split = W.split(part.column("text"), W.LETTERS_AND_DIGITS, lower=True)
                values = W.hashes(split)
                starts, keys = window_grams(values, split.first, gram, span)
                short = np.flatnonzero(split.counts < span)
                lengths = split.counts[short]
                own = [W.grams(values[at : at + size], size) for at, size in zip(split.first[short], lengths, strict=True)]
                starts = np.concatenate([starts, split.first[short]])
                keys = np.concatenate([keys, *own]).view(np.int64)
                sizes = np.concatenate([np.full(len(starts) - len(short), span), lengths])
                text = np.searchsorted(split.first, starts, side="right") - 1
                for at in range(0, len(starts), EMITTED):
                    some = slice(at, at + EMITTED)
                    windows = [digest(split, start, start + size) for start, size in zip(starts[some], sizes[some], strict=True)]
                    columns = [
                        pa.array(keys[some]),
                        pa.array(windows, pa.binary()),
                        pa.array(sizes[some], pa.int32()),
                        part.column("entry").take(pa.array(text[some])),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["gram", "window", "size", "entry"])

    return emit


def document_windows(gram: int, span: int, sizes: list[int], bits: int, shared):
    """The windows of documents whose kept gram may be one of the benchmark's, each once a text with its ``places``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in W.slices(batch, "text"):
                split = W.split(part.column("text"), W.LETTERS_AND_DIGITS, lower=True)
                values = W.hashes(split)
                places: dict[tuple[int, int, bytes], list[int]] = defaultdict(list)
                for size in (*sizes, span):
                    if size == span:
                        starts, keys = window_grams(values, split.first, gram, span)
                    else:
                        keys = W.grams(values, size)
                        starts = np.arange(len(keys))
                    keys = keys.view(np.int64)
                    bit = np.mod(keys, bits).astype(np.uint64)
                    hit = (known[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                    starts, keys = starts[hit], keys[hit]
                    text = np.searchsorted(split.first, starts, side="right") - 1
                    inside = starts + size <= split.first[text + 1]
                    found = zip(text[inside].tolist(), keys[inside].tolist(), starts[inside].tolist(), strict=True)
                    for number, key, start in found:
                        places[number, key, digest(split, start, start + size)].append(start - int(split.first[number]))
                seeds = list(places)
                for at in range(0, len(seeds), EMITTED):
                    some = seeds[at : at + EMITTED]
                    columns = [
                        pa.array([key for _, key, _ in some], pa.int64()),
                        pa.array([window for _, _, window in some], pa.binary()),
                        part.column("text_key").take(pa.array([number for number, _, _ in some], pa.int64())),
                        pa.array([places[seed] for seed in some], pa.list_(pa.int32())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["gram", "window", "text_key", "places"])

    return emit


def joined_windows(texts: DataFrame, items: DataFrame, gram: int, span: int, filter_bits: int) -> DataFrame:
    """``spans`` and ``items`` of each ``text_key`` that shares a window with an item, by a join of kept grams."""
    named = written(items.mapInArrow(entries, ENTRIES), "entries")
    distinct = named.groupBy("entry").agg(F.min("text").alias("text"))
    windows = written(distinct.mapInArrow(item_windows(gram, span), WINDOWS).distinct(), "item-windows")
    sizes = [row[0] for row in windows.where(F.col("size") < span).select("size").distinct().collect()]
    known = texts.sparkSession.sparkContext.broadcast(bit_map(windows.select(F.col("gram").alias("mini")), filter_bits))
    hits = written(texts.mapInArrow(document_windows(gram, span, sorted(sizes), filter_bits, known), HITS), "seeds")

    met = hits.join(windows.select("gram", "window", "size").distinct(), ["gram", "window"])
    begin = F.col("begin").cast("long")
    placed = met.select("text_key", "size", F.explode("places").alias("begin"))
    runs = placed.select("text_key", begin.alias("begin"), (begin + F.col("size")).alias("end")).distinct()
    along = Window.partitionBy("text_key").orderBy("begin", "end")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("begin") <= reached, 0).otherwise(1)
    hit = runs.withColumn("opens", opens).withColumn("number", F.sum("opens").over(along))
    merged_runs = hit.groupBy("text_key", "number").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    spans = merged_runs.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))

    held = hits.select("gram", "window", "text_key").join(windows.drop("size"), ["gram", "window"])
    names = held.select("text_key", "entry").distinct().join(named.select("entry", "name").distinct(), "entry")
    names = names.groupBy("text_key").agg(F.array_sort(F.collect_set("name")).alias("items"))
    return written(spans.join(names, "text_key"), "found-windows")


def mark_joined(documents: DataFrame, items: DataFrame, gram: int, span: int, filter_bits: int) -> DataFrame:
    """``row`` beside ``found`` for a benchmark of any size; texts are known by a digest, so copies share their windows."""
    text = F.coalesce("text", F.lit(""))
    keyed = documents.select(ROW, text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"))
    found = joined_windows(keyed.select("text_key", "text"), items, gram, span, filter_bits)
    rows = keyed.select(ROW, "text_key", F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long").alias("n_words"))
    weight = F.size("spans") + F.size("items")
    marked = joined(rows, found, "text_key", "left", BROADCAST_ROWS, weight)
    result = F.struct("n_words", F.coalesce("spans", F.array()).alias("spans"), F.coalesce("items", F.array()).alias("items"))
    return marked.select(ROW, result.cast(SQL_RESULT).alias("found"))


def distinct_items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """``name`` and ``text`` of the items, each pair once, written."""
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    return written(items.distinct(), "items")


def small_index(items: DataFrame, gram: int, span: int, block_bytes: int) -> Items | None:
    """The index of a benchmark within its bounds; none of a larger one, which isn't fetched then."""
    if (items.agg(F.sum(F.octet_length("name") + F.octet_length("text") + 16)).first()[0] or 0) > block_bytes:
        return None
    index = index_items([(row.name, row.text) for row in items.collect()], gram, span)
    return None if max(map(len, index.places.values()), default=0) > MOST_PLACES else index


def mark_benchmark(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    gram: int = GRAM,
    span: int = SPAN,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Each document as ``row`` beside ``found``: ``n_words``, the merged hit word ``spans`` and the sorted ``items``.

    ``keep`` names the columns of ``row``, all by default. The result doesn't depend on ``block_bytes``.
    """
    if not 0 < gram <= span:
        raise ValueError("gram must be from 1 to span")
    frame = whole_rows(documents, keep, text=text)
    items = distinct_items(benchmark, item_id, item_text)
    index = small_index(items, gram, span, block_bytes)
    if index is None:
        return mark_joined(frame, items, gram, span, filter_bits)
    schema = frame.select(ROW, F.lit(None).cast(SQL_RESULT).alias("found")).schema
    shared = documents.sparkSession.sparkContext.broadcast(index)
    return frame.mapInArrow(marker(shared, gram, span), schema)


def hit_words(found) -> F.Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["begin"])
