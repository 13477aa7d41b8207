"""Near-duplicate documents by 64-bit similarity fingerprints and multi-index hashing.

A fingerprint bit is set if it is set in over half of the XXH64 hashes (seed 42) of the document's word shingles. Two
fingerprints that differ in at most 3 of 64 bits differ in at most one bit of their lower or of their upper half. So each
distinct fingerprint stands in a table under both halves and looks under both halves and under all 32 neighbours of each
half at one bit's distance. What it finds is verified on all 64 bits.

A half that more than ``heavy`` distinct fingerprints share would give pairs with the square of their number. There, links
go over meeting points instead: values of the other half. Fingerprints within one bit of a point meet, as anchors, those
within two bits that share the half, and those within one bit whose half is one bit off. All of these are within 3 bits of
each anchor, and any two fingerprints within 3 bits meet at some point; each point links its visitors with its smallest
anchor. That emits 562 rows a fingerprint, however many share the half, and gives the same components.

Null texts and texts without words have the fingerprint zero, which links like any other. Rows without a doc_id take part;
a component's id is its smallest doc_id that isn't null, or null where there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import words as W
from tallyline.llm.components import components
from tallyline.llm.frames import joined, whole_rows, written

SHINGLE = 3
BITS = 3
HALF = 32
HEAVY = 64
SEED = 42
SLICE_BYTES = 1 << 20
BLOCK = 1 << 16
BROADCAST_ROWS = 1_000_000


def compact(split: W.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of each text joined by one space, with the spans of the words."""
    lengths = split.end - split.begin
    last = np.zeros(len(lengths), dtype=bool)
    last[split.first[1:][split.counts > 0] - 1] = True
    kept = split.inside.copy()
    gaps = split.end[~last]
    kept[gaps] = True
    data = split.data.copy()
    data[gaps] = 0x20
    ends = np.cumsum(lengths + ~last)
    begin = ends - lengths - ~last
    return data[kept].tobytes(), begin, begin + lengths


def shingles(split: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each shingle of each text; a shorter text is one shingle."""
    counts = split.counts
    number = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    heads = np.cumsum(number) - number
    first = np.arange(int(number.sum())) - np.repeat(heads - split.first[:-1], number)
    return first, np.minimum(first + size, np.repeat(split.first[1:], number)) - 1


def fingerprints(split: W.Words, size: int) -> np.ndarray:
    text, begin, end = compact(split)
    first, last = shingles(split, size)
    digest = xxhash.xxh64_intdigest
    counts = split.counts
    number = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    owner = np.repeat(np.arange(len(number)), number)
    ones = np.zeros((len(number), 64), dtype=np.int64)
    for start in range(0, len(first), BLOCK):
        part = slice(start, start + BLOCK)
        spans = zip(begin[first[part]].tolist(), end[last[part]].tolist(), strict=True)
        hashed = np.array([digest(text[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.diff(owner[part], prepend=-1))
        ones[owner[part][heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    set_bits = (2 * ones > number[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").reshape(-1, 8).view("<u8")[:, 0]


def fingerprint(documents: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Each document as ``row``, of all or of the kept columns, beside its ``fingerprint``, the 64 bits as a long."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                split = W.split(part.column("text"), W.NOT_SPACES, lower=True)
                found = pa.array(fingerprints(split, shingle).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("row"), found], names=["row", "fingerprint"])

    frame = whole_rows(documents, keep, text=text)
    schema = frame.select("row", F.lit(0).cast("long").alias("fingerprint")).schema
    return frame.mapInArrow(add, schema)


def halves(value):
    """Both halves as keys: the half's number in bit 32, the half below."""
    low = value.bitwiseAND(F.lit((1 << HALF) - 1))
    high = F.shiftrightunsigned(value, HALF).bitwiseOR(F.lit(1 << HALF))
    return low, high


def flips(value, count: int):
    """The value with one, or with two, of its lower 32 bits flipped."""
    one = [1 << bit for bit in range(HALF)]
    masks = one if count == 1 else [a | b for number, a in enumerate(one) for b in one[:number]]
    return F.transform(F.array(*[F.lit(mask).cast("long") for mask in masks]), lambda mask: value.bitwiseXOR(mask))


def differing(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, heavy: int) -> DataFrame:
    """Edges between distinct fingerprints (``fp``) that connect exactly those within 3 bits."""
    fp = F.col("fp")
    low, high = halves(fp)
    table = distinct.select(F.explode(F.array(low, high)).alias("key"), "fp")
    probe = distinct.select(
        F.explode(F.concat(F.array(low, high), flips(low, 1), flips(high, 1))).alias("key"), F.col("fp").alias("other")
    )
    crowded = written(table.groupBy("key").count().where(F.col("count") > heavy).select("key"), "crowded")
    few = joined(table, crowded, "key", "left_anti", BROADCAST_ROWS)
    close = (F.col("fp") != F.col("other")) & (differing(F.col("fp"), F.col("other")) <= BITS)
    edges = probe.join(few, (probe["key"] == few["key"]) & close).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if crowded.isEmpty():
        return edges
    return edges.union(meetings(joined(probe, crowded, "key", "left_semi", BROADCAST_ROWS)))


def meetings(visits: DataFrame) -> DataFrame:
    """Edges from the visitors of each meeting point to its smallest anchor."""
    key, fp = F.col("key"), F.col("other")
    low, high = halves(fp)
    in_upper = key >= F.lit(1 << HALF)
    own, rest = F.when(in_upper, high).otherwise(low), F.when(in_upper, low).otherwise(high)
    shares = own == key
    near = F.concat(F.array(rest), flips(rest, 1))
    points = F.transform(near, lambda point: F.struct(point.alias("point"), shares.alias("anchor")))
    far = F.transform(flips(rest, 2), lambda point: F.struct(point.alias("point"), F.lit(False).alias("anchor")))
    rows = visits.select("key", F.col("other").alias("fp"), F.explode(F.when(shares, F.concat(points, far)).otherwise(points)).alias("at"))
    rows = rows.select("key", "at.point", "fp", "at.anchor")
    anchors = rows.where("anchor").groupBy("key", "point").agg(F.min("fp").alias("a"))
    return rows.join(anchors, ["key", "point"]).where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def group(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    heavy: int = HEAVY,
    keep: list[str] | None = None,
) -> DataFrame:
    """Each document as ``row`` beside ``fingerprint``, ``component_id`` and ``first``.

    ``keep`` names the columns of ``row``, which are written to the shared folder; doc_id must be among them.
    ``first`` marks exactly one row of each component: that with the smallest doc_id, and one of those if it is repeated.
    """
    ident = F.col("row").getField(doc_id)
    marked = written(fingerprint(documents, text, shingle, keep).withColumn("place", F.monotonically_increasing_id()), "fingerprints")
    order = F.struct(ident.isNull().alias("none"), ident.alias("id"), F.col("place").alias("place"))
    distinct = written(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(order).alias("least")), "distinct")
    linked = components(links(distinct.select("fp"), heavy)).withColumnRenamed("node", "fp")
    labelled = distinct.join(linked, "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    least = labelled.groupBy("component").agg(F.min("least").alias("head"))
    heads = written(labelled.join(least, "component").select("fp", "head"), "heads")
    return joined(marked, heads, marked["fingerprint"] == heads["fp"], "inner", BROADCAST_ROWS).select(
        "row",
        "fingerprint",
        F.col("head")["id"].alias("component_id"),
        (F.col("head")["place"] == F.col("place")).alias("first"),
    )
