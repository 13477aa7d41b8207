"""Web archives: pages written as WARC records, and records read back with their segments joined again.

Writing. Each page becomes one record whose block is an HTTP response in chunked transfer framing. A block over
``segment_bytes`` is cut: the first part stays in the page's own record, with segment number 1, and continuation records
carry the others, with the first record's id as origin; the last one tells the length of the whole block. Of records with
equal payloads of ``revisit_bytes`` or more, the one with the smallest page_id holds the payload and the others are
revisits of it. Spark's own writer makes the files, gzip streams of records each ended by an empty line, so that lost
tasks leave nothing behind and any file system of the cluster will do.

Reading. Files are parsed as streams. Records in one piece are decoded where they are found. Segments are grouped by origin,
put in the order of their numbers and checked: numbers without gaps, one total, and that total equal to the length. A
revisit gets the payload's length and digest from the record that it refers to. A broken record is an error.

Null html is an empty payload, a null url an empty target. Rows that repeat a page, its id included, are records of their
own: one holds the payload, the others revisit it. Rows without a page_id come after all others in that order.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.frames import joined, written
from tallyline.session import scratch_path

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
REVISIT_BYTES = 100
FILE_RECORDS = 20_000
BROADCAST_ROWS = 500_000
READ_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(place: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=place)}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = (payload[start : start + size] for start in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(part), part) for part in parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The payload of a chunked body."""
    parts, at = [], 0
    while True:
        stop = framed.index(b"\r\n", at)
        size = int(framed[at:stop].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        part = framed[stop + 2 : stop + 2 + size]
        at = stop + 2 + size + 2
        if len(part) < size or framed[at - 2 : at] != b"\r\n":
            raise ValueError("a chunk is shorter than it says")
        parts.append(part)


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(kind: str, ident: str, fields: dict[str, str], block: bytes) -> bytes:
    """One record without the empty line that ends it."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Date": DATE, **fields, "Content-Length": str(len(block))}
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def page_records(page: dict, segment_bytes: int) -> Iterator[bytes]:
    payload = (page["html"] or "").encode()
    ident = record_id(page["place"])
    target = "".join(f"%{ord(c):02X}" if c in " \r\n\t" else c for c in page["url"] or "")
    fields = {
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
        "Content-Type": "application/http;msgtype=response",
    }
    if page["page_id"] is not None:
        fields["X-Page-ID"] = str(page["page_id"])
    if page["leader"] is not None and page["leader"] != page["place"]:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(page["leader"])}
        yield record("revisit", ident, fields, HTTP + b"\r\n")
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield record("response", ident, fields, block)
        return
    yield record("response", ident, fields | {"WARC-Segment-Number": "1"}, block[:segment_bytes])
    for number, start in enumerate(range(segment_bytes, len(block), segment_bytes), start=2):
        more = {"WARC-Segment-Origin-ID": ident, "WARC-Segment-Number": str(number)}
        if start + segment_bytes >= len(block):
            more["WARC-Segment-Total-Length"] = str(len(block))
        own = f"<urn:uuid:{uuid.uuid5(uuid.UUID(int=page['place']), str(number))}>"
        yield record("continuation", own, more, block[start : start + segment_bytes])


def leaders(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """``digest``, ``size`` and ``leader`` (the place of the response) of payloads that occur more than once."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "place")
    return (
        pages.where(F.col("size") >= revisit_bytes)
        .groupBy("digest", "size")
        .agg(F.min(order)["place"].alias("leader"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )


def write_archive(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    segment_bytes: int = SEGMENT_BYTES,
    revisit_bytes: int = REVISIT_BYTES,
) -> None:
    """Writes one record per row, and continuation records, to gzipped files in the folder."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = written(
        pages.select(
            F.monotonically_increasing_id().alias("place"),
            F.col(f"`{page_id}`").cast("long").alias("page_id"),
            F.col(f"`{url}`").alias("url"),
            F.col(f"`{html}`").alias("html"),
            F.unhex(F.sha2(payload, 256)).alias("digest"),
            F.length(payload).alias("size"),
        ),
        "pages",
    )
    known = written(leaders(rows, revisit_bytes), "leaders")
    led = joined(rows, known, ["digest", "size"], "left", BROADCAST_ROWS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = [one for page in batch.slice(start, 256).to_pylist() for one in page_records(page, segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = led.select("place", "page_id", "url", "html", "leader").mapInArrow(build, "record binary")
    (
        records.select(F.col("record").cast("string"))
        .write.option("lineSep", END.decode())
        .option("compression", "gzip")
        .option("maxRecordsPerFile", FILE_RECORDS)
        .text(path)
    )


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and block of each record of a gzipped file."""
    source, waiting, buffer, at = zlib.decompressobj(31), content, b"", 0

    def more(needed: int) -> None:
        nonlocal buffer, at, waiting, source
        parts, have = [buffer[at:]], len(buffer) - at
        while have < needed and waiting:
            parts.append(source.decompress(waiting, READ_BYTES))
            waiting = source.unconsumed_tail
            if source.eof:
                waiting, source = source.unused_data, zlib.decompressobj(31)
            have += len(parts[-1])
        buffer, at = b"".join(parts), 0

    while True:
        stop = buffer.find(END, at)
        if stop < 0:
            before = len(buffer) - at
            more(before + READ_BYTES)
            if len(buffer) == before:
                if before:
                    raise ValueError("the file ends within a record")
                return
            continue
        lines = buffer[at:stop].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {name.decode().lower(): value.strip().decode() for name, _, value in (line.partition(b":") for line in lines[1:])}
        at = stop + len(END)
        size = int(fields["content-length"])
        if len(buffer) - at < size + len(END):
            more(size + len(END))
        block = buffer[at : at + size]
        if len(block) < size or buffer[at + size : at + size + len(END)] != END:
            raise ValueError("a record is shorter than it says")
        at += size + len(END)
        yield fields, block


RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("refers_to", pa.string()),
        ("digest", pa.string()),
        ("number", pa.int64()),
        ("total", pa.int64()),
        ("payload", pa.binary()),
    ]
)
SQL_RECORD = (
    "record_id string, record_type string, page_id bigint, url string, refers_to string, digest string, number bigint, "
    "total bigint, payload binary"
)


def row_of(fields: dict[str, str], block: bytes, in_parts: bool) -> dict:
    number = lambda name: int(fields[name]) if name in fields else None
    kind = fields["warc-type"]
    return {
        "record_id": fields.get("warc-segment-origin-id", fields["warc-record-id"]),
        "record_type": kind,
        "page_id": number("x-page-id"),
        "url": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"),
        "digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
        "number": number("warc-segment-number"),
        "total": number("warc-segment-total-length"),
        "payload": block if in_parts else None if kind == "revisit" else payload_of(block),
    }


def reader(in_parts: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for fields, block in parsed(content.as_py()):
                    if ("warc-segment-number" in fields) == in_parts:
                        rows.append(row_of(fields, block, in_parts))
                        held += len(block)
                        if held > 4 * READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORD)

    return read


def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(batch.num_rows):
            (row,) = batch.slice(start, 1).to_pylist()
            parts = row.pop("parts")
            block = b"".join(part["payload"] for part in parts)
            totals = [part["total"] for part in parts if part["total"] is not None]
            if [part["number"] for part in parts] != list(range(1, len(parts) + 1)) or totals != [len(block)]:
                raise ValueError(f"segments of {row['record_id']} don't make up a record")
            row |= {"number": len(parts), "total": len(block), "payload": payload_of(block)}
            yield pa.RecordBatch.from_pylist([row], RECORD)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records that aren't continuations, with their decoded payloads; null for revisits.

    ``number`` and ``total`` tell the segments and the block length of a record that was cut.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    whole = files.mapInArrow(reader(False), SQL_RECORD)
    grouped = (
        files.mapInArrow(reader(True), SQL_RECORD)
        .groupBy("record_id")
        .agg(
            *[
                F.max(name).alias(name)
                for name in ("page_id", "url", "refers_to", "digest")
            ],
            F.max(F.when(F.col("record_type") != "continuation", F.col("record_type"))).alias("record_type"),
            F.sort_array(F.collect_list(F.struct("number", "total", "payload"))).alias("parts"),
        )
    )
    return whole.union(grouped.mapInArrow(reassemble, SQL_RECORD))


def resolved(records: DataFrame) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` (a page_id) of each record."""
    found = written(
        records.select(
            "record_id",
            "page_id",
            "record_type",
            F.col("refers_to").alias("origin"),
            F.length("payload").cast("long").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_digest"),
        ),
        "records",
    )
    origin = found.where("record_type <> 'revisit'").select(
        F.col("record_id").alias("origin"),
        F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("origin_bytes"),
        F.col("payload_digest").alias("origin_digest"),
    )
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type")
    revisits = (
        found.where("record_type = 'revisit'")
        .join(origin, "origin", "left")
        .select("page_id", F.col("origin_bytes"), F.col("origin_digest"), "record_type", "refers_to")
    )
    own = found.where("record_type <> 'revisit'").select(*columns, F.lit(None).cast("long").alias("refers_to"))
    return own.union(revisits)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to a new archive in the shared folder and read back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archive")
    write_archive(pages, path)
    return resolved(read_archive(spark, path))
