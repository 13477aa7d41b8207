"""Token ids of a corpus in files of rANS blocks, in ascending order of doc_id, and their way back.

The documents are range partitioned on doc_id and sorted, and each task turns its documents into files of about
``FILE_TOKENS`` tokens, so no task holds more than that and one document. Spark's own writer makes the files, one for
each row, so that lost tasks leave nothing behind and any file system of the cluster will do.

A file is ``MAGIC``, the length of its head, the head, the blocks and a line end. The head is compressed with zlib: the
file's place (partition, number), its documents (doc_id, null or not, number of tokens), the frequency table that all of
its blocks share, and a checkpoint for each block: its offset, its number of tokens and its CRC-32. Each block starts from
its own states, so blocks can be fetched and decoded alone and in any order. The table counts all tokens of the file.

Each document's ids are followed by ``end``. Null texts are empty. Rows without a doc_id come first; rows that repeat a
doc_id follow each other in the order of their texts' hashes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import rans
from tallyline.llm.frames import shuffle_partitions, written
from tallyline.llm.tokens import encoded
from tallyline.session import scratch_path

MAGIC = b"TLYRANS1"
END = 2
FILE_TOKENS = 2_000_000
PARTITION_BYTES = 64 << 20
IDS = "partition int, number int, nth bigint, doc_id bigint, before bigint, n_tokens bigint, ids binary"


def array_bytes(values: np.ndarray, kind: str) -> bytes:
    body = values.astype(kind).tobytes()
    return struct.pack("<Q", len(body)) + body


def arrays(head: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(head):
        (size,) = struct.unpack_from("<Q", head, at)
        yield head[at + 8 : at + 8 + size]
        at += 8 + size


def file_bytes(partition: int, number: int, ids: list[int | None], texts: list[bytes]) -> bytes:
    """A file of these documents, without its line end."""
    tokens = np.frombuffer(b"".join(texts), "<u4")
    counts = np.bincount(tokens)
    symbols = np.flatnonzero(counts)
    frequencies = rans.scaled(counts[symbols])
    blocks = rans.encode((np.cumsum(counts > 0) - 1)[tokens], frequencies)
    sizes = [len(block) for block in blocks]
    head = zlib.compress(
        b"".join(
            (
                array_bytes(np.array([partition, number]), "<i8"),
                array_bytes(np.array([0 if ident is None else ident for ident in ids], dtype=np.int64), "<i8"),
                array_bytes(np.array([ident is None for ident in ids]), "u1"),
                array_bytes(np.array([len(text) // 4 for text in texts]), "<u8"),
                array_bytes(np.diff(symbols, prepend=0), "<u4"),
                array_bytes(frequencies, "<u4"),
                array_bytes(np.cumsum([0, *sizes[:-1]]) if sizes else np.zeros(0), "<u8"),
                array_bytes(block_sizes(len(tokens)), "<u4"),
                array_bytes(np.array([zlib.crc32(block) for block in blocks]), "<u4"),
            )
        ),
        3,
    )
    return MAGIC + struct.pack("<Q", len(head)) + head + b"".join(blocks)


def block_sizes(tokens: int) -> np.ndarray:
    starts = np.arange(0, tokens, rans.BLOCK)
    return np.minimum(tokens - starts, rans.BLOCK)


def file_documents(content: bytes) -> Iterator[dict]:
    """The documents of a file, in order. A block that fails its checksum is an error."""
    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    (size,) = struct.unpack_from("<Q", content, len(MAGIC))
    body = len(MAGIC) + 8 + size
    place, ids, none, counts, symbols, frequencies, offsets, sizes, sums = (
        np.frombuffer(part, kind)
        for part, kind in zip(
            arrays(zlib.decompress(content[body - size : body])),
            ("<i8", "<i8", "u1", "<u8", "<u4", "<u4", "<u8", "<u4", "<u4"),
            strict=True,
        )
    )
    ends = [*offsets[1:].tolist(), len(content) - 1 - body]
    blocks = [content[body + a : body + b] for a, b in zip(offsets.tolist(), ends, strict=True)] if len(offsets) else []
    for number, block in enumerate(blocks):
        if zlib.crc32(block) != sums[number]:
            raise ValueError(f"block {number} is damaged")
    table = np.cumsum(symbols.astype(np.int64)).astype("<u4")
    tokens = table[rans.decode(blocks, sizes.tolist(), frequencies.astype(np.uint64))] if blocks else np.zeros(0, "<u4")
    stops = np.cumsum(counts).tolist()
    for nth, stop in enumerate(stops):
        count = int(counts[nth])
        yield {
            "partition": int(place[0]),
            "number": int(place[1]),
            "nth": nth,
            "doc_id": None if none[nth] else int(ids[nth]),
            "before": stop - count,
            "n_tokens": count,
            "ids": tokens[stop - count : stop].tobytes(),
        }


def filer(tokenizer: str, end: int, file_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        last = struct.pack("<I", end)
        ids, texts, held, number = [], [], 0, 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file_bytes(partition, number, ids, texts)], pa.binary())], names=["file"])

        for batch in batches:
            for part, found in encoded(tokenizer, batch):
                for ident, text in zip(part.column("doc_id").to_pylist(), found, strict=True):
                    ids.append(ident)
                    texts.append(text + last)
                    held += len(text) // 4 + 1
                    if held >= file_tokens:
                        yield file()
                        ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield file()

    return pack


def write_ids(
    documents: DataFrame,
    path: str,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end: int = END,
    file_tokens: int = FILE_TOKENS,
) -> None:
    """Writes the ids of all texts, each followed by ``end``, to files in the folder, in ascending order of doc_id."""
    spark = documents.sparkSession
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ("doc_id", "tie")
    ordered = (
        rows.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(max(shuffle_partitions(spark), size // PARTITION_BYTES), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    files = ordered.mapInArrow(filer(tokenizer, end, file_tokens), "file binary")
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all files: place of the file, place in it, doc_id, tokens before it in the file, and its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("partition", pa.int32()), ("number", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64())]
            + [("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
        )
        for batch in batches:
            for content in batch.column("content"):
                rows = list(file_documents(content.as_py()))
                for start in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_pylist(rows[start : start + 1000], schema)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(read, IDS)


def with_starts(found: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before it in the corpus.

    The running total goes over one row for each file, which is why it may run in one task.
    """
    from pyspark.sql import Window

    files = found.groupBy("partition", "number").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("partition", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long"))).drop("tokens")
    return found.join(files, ["partition", "number"]).withColumn("start", F.col("first") + F.col("before"))


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, from files written to the shared folder."""
    spark = documents.sparkSession
    path = scratch_path(spark, "ids")
    write_ids(documents, path, tokenizer)
    found = read_ids(spark, path).select(
        "partition", "number", "doc_id", "before", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
    return with_starts(written(found, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
