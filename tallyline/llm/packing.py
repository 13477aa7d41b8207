"""Packing of token pieces into sequences of bounded length, by a grouping genetic algorithm on islands.

Pieces of the full length are sequences by themselves. The others are dealt at random into shards of about ``shard``
pieces. Each shard is evolved on several islands, which are groups of their own in Spark: an island starts from best-fit
solutions and crosses them by whole bins (see ``grouping``). After each epoch the best solution of every island migrates to
the next island of its shard. The best solution of all islands of a shard wins.

What a shard can't fill well is pooled: the pieces of its sequences below ``well_filled`` of the limit are dealt into fewer
shards and packed again, for ``rounds`` rounds. Every group holds a bounded number of pieces, whatever the input.

A piece without a length, or with one below 1 or over the limit, gets no sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import grouping
from tallyline.llm.frames import ROW, whole_rows, written
from tallyline.llm.tokens import encoded

LIMIT = 1024
END = 2
SHARD = 16_384
ISLANDS = 2
EPOCHS = 3
POPULATION = 6
GENERATIONS = 30
ROUNDS = 3
WELL_FILLED = 0.995
BATCH_IDS = 1 << 20
PIECES = "piece int, start bigint, length bigint, ids binary"
STATE = "shard bigint, island int, guest boolean, places binary, lengths binary, solutions array<binary>"


def pieces(
    documents: DataFrame,
    tokenizer: str,
    text: str = "text",
    limit: int = LIMIT,
    end: int = END,
    keep: list[str] | None = None,
) -> DataFrame:
    """The token ids of each document and ``end``, in pieces of at most ``limit`` ids.

    Columns: the document as ``row``, ``piece`` from 0, ``start`` (the document's ids before it), ``length`` and ``ids``
    (little-endian unsigned 32-bit). Only longer documents are cut, and then only the first piece may be shorter than
    ``limit``. A null text is empty, so it has one piece that holds only ``end``.

    ``row`` goes with every piece, so it has the ``keep`` columns, or all but the text, which would make a document's
    pieces as large as its square. A table without other columns gets a ``row_id`` in it. Pieces leave a task in batches
    of about ``BATCH_IDS`` ids, however long a text is.
    """
    last = int(end).to_bytes(4, "little")
    most = max(1, BATCH_IDS // limit)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in encoded(tokenizer, batch):
                sizes = np.array([len(ids) // 4 + 1 for ids in found], dtype=np.int64)
                counts = -(-sizes // limit)
                owner = np.repeat(np.arange(len(sizes)), counts)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                first = sizes - (counts - 1) * limit
                start = np.where(number > 0, first[owner] + (number - 1) * limit, 0)
                length = np.where(number > 0, limit, first[owner])
                whole = [ids + last for ids in found]
                for low in range(0, len(owner), most):
                    own = slice(low, low + most)
                    spans = zip(owner[own].tolist(), (4 * start[own]).tolist(), (4 * (start[own] + length[own])).tolist(), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(ROW).take(pa.array(owner[own])),
                            pa.array(number[own], pa.int32()),
                            pa.array(start[own]),
                            pa.array(length[own]),
                            pa.array([whole[n][a:b] for n, a, b in spans], pa.binary()),
                        ],
                        names=[ROW, "piece", "start", "length", "ids"],
                    )

    keep = [name for name in documents.columns if name != text] if keep is None else keep
    if not keep:
        documents, keep = documents.withColumn("row_id", F.monotonically_increasing_id()), ["row_id"]
    frame = whole_rows(documents, keep, text=text)
    schema = frame.select(ROW, *[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in PIECES.split(", "))])
    return frame.mapInArrow(cut, schema.schema)


def state(shard: int, island: int, places: np.ndarray, lengths: np.ndarray, population: list[np.ndarray]) -> pa.Table:
    return pa.table(
        {
            "shard": pa.array([shard], pa.int64()),
            "island": pa.array([island], pa.int32()),
            "guest": pa.array([False]),
            "places": pa.array([places.astype("<i8").tobytes()], pa.binary()),
            "lengths": pa.array([lengths.astype("<i4").tobytes()], pa.binary()),
            "solutions": pa.array([[own.astype("<i4").tobytes() for own in population]], pa.list_(pa.binary())),
        }
    )


def settle(limit: int, size: int, generations: int):
    def begin(key: tuple, items: pa.Table) -> pa.Table:
        """First population of an island and its first epoch."""
        shard, island = (one.as_py() for one in key)
        places, lengths = items.column("place").to_numpy(), items.column("length").to_numpy().astype(np.int64)
        order = np.lexsort((places, -lengths))
        places, lengths = places[order], lengths[order]
        rng = np.random.default_rng((shard, island, 0))
        population = grouping.evolve(lengths, grouping.start(lengths, limit, size, rng), limit, generations, rng)
        return state(shard, island, places, lengths, population)

    return begin


def next_epoch(limit: int, generations: int, epoch: int):
    def go_on(key: tuple, rows: pa.Table) -> pa.Table:
        """An epoch of an island with the guests that came; the weakest of its own solutions make room for them."""
        shard, island = (one.as_py() for one in key)
        own, guests = None, []
        for row in rows.to_pylist():
            found = [np.frombuffer(solution, "<i4").astype(np.int64) for solution in row["solutions"]]
            if row["guest"]:
                guests += found
            else:
                own, population = row, found
        places, lengths = np.frombuffer(own["places"], "<i8"), np.frombuffer(own["lengths"], "<i4").astype(np.int64)
        population = population[: max(1, len(population) - len(guests))] + guests
        rng = np.random.default_rng((shard, island, epoch))
        return state(shard, island, places, lengths, grouping.evolve(lengths, population, limit, generations, rng))

    return go_on


def best_of(limit: int):
    def choose(rows: pa.Table) -> pa.Table:
        """The pieces of a shard with their bins in the best solution of its islands."""
        islands = sorted(rows.to_pylist(), key=lambda row: row["island"])
        lengths = np.frombuffer(islands[0]["lengths"], "<i4").astype(np.int64)
        found = [np.frombuffer(row["solutions"][0], "<i4").astype(np.int64) for row in islands]
        bins = max(found, key=lambda own: grouping.fitness(lengths, own, limit))
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        opens = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = ends - lengths[order] - np.repeat((ends - lengths[order])[opens], np.diff(np.append(opens, len(order))))
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        return pa.table(
            {
                "place": pa.array(np.frombuffer(islands[0]["places"], "<i8")[order]),
                "length": pa.array(lengths[order]),
                "shard": pa.array(np.full(len(order), islands[0]["shard"])),
                "bin": pa.array(bins[order]),
                "offset": pa.array(offset),
                "fill": pa.array(fill[bins[order]]),
            }
        )

    return choose


def evolved(items: DataFrame, count: int, limit: int, shard: int, islands: int, epochs: int) -> DataFrame:
    """``place``, ``length``, ``shard``, ``bin``, ``offset`` and ``fill`` of items packed once in shards."""
    shards = max(1, -(-count // shard))
    dealt = items.select(
        "place",
        "length",
        F.pmod(F.xxhash64("place"), F.lit(shards)).alias("shard"),
        F.explode(F.array(*[F.lit(n) for n in range(islands)])).alias("island"),
    )
    both = ["shard", "island"]
    found = written(dealt.groupBy(both).applyInArrow(settle(limit, POPULATION, GENERATIONS), STATE), "islands")
    for epoch in range(1, epochs):
        guests = found.select(
            "shard",
            F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"),
            F.lit(True).alias("guest"),
            F.lit(None).cast("binary").alias("places"),
            F.lit(None).cast("binary").alias("lengths"),
            F.slice("solutions", 1, 1).alias("solutions"),
        )
        moved = found.union(guests) if islands > 1 else found
        found = written(moved.groupBy(both).applyInArrow(next_epoch(limit, GENERATIONS, epoch), STATE), "islands")
    packed = "place bigint, length bigint, shard bigint, bin bigint, offset bigint, fill bigint"
    return found.groupBy("shard").applyInArrow(best_of(limit), packed)


def pack(
    frame: DataFrame,
    length: str = "length",
    limit: int = LIMIT,
    shard: int = SHARD,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    rounds: int = ROUNDS,
    well_filled: float = WELL_FILLED,
) -> DataFrame:
    """Each row of the frame as ``row`` beside its ``sequence_id`` and its ``offset`` there."""
    rows = written(whole_rows(frame, length=length).withColumn("place", F.monotonically_increasing_id()), "pieces")
    sizes = rows.select("place", F.col("length").cast("long").alias("length"))
    parts = [
        sizes.where(F.col("length") == limit).select(
            "place", (-1 - F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
        )
    ]
    open_ = sizes.where((F.col("length") >= 1) & (F.col("length") < limit))
    for number in range(rounds):
        count = open_.count()
        if not count:
            break
        packed = written(evolved(open_, count, limit, shard, islands, epochs), "packed")
        last = number == rounds - 1 or count <= shard
        done = F.lit(True) if last else F.col("fill") >= well_filled * limit
        sequence = F.lit(number << 56) + F.shiftleft("shard", 24) + F.col("bin")
        parts.append(packed.where(done).select("place", sequence.alias("sequence_id"), "offset"))
        if last:
            break
        open_ = packed.where(~done).select("place", "length")
    placed = reduce(DataFrame.union, parts)
    return rows.join(placed, "place", "left").select(ROW, "sequence_id", "offset")


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """The token ids of each sequence, from packed pieces that have them: ``sequence_id`` and ``ids``."""
    part = F.struct("offset", F.col(ROW)[ids].alias("ids"))
    joined_ = F.aggregate(
        F.sort_array(F.collect_list(part)), F.lit(b"").cast("binary"), lambda whole, piece: F.concat(whole, piece["ids"])
    )
    return packed.where("sequence_id is not null").groupBy("sequence_id").agg(joined_.alias("ids"))
