from __future__ import annotations

import gzip
import hashlib

import pytest

from tallyline.llm import warc
from tallyline.session import scratch_path

SCHEMA = "page_id long, url string, html string"


def archive(spark, frame, **options):
    path = scratch_path(spark, "test-archive")
    warc.write_archive(frame, path, **options)
    return path


def test_payloads_come_back_from_segments(spark):
    big = "é<p>" * 30_000
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, None), (3, "u", ""), (4, "u", "WARC/1.1\r\n\r\n" * 500), (None, "u", "x" * 40_000)]
    path = archive(spark, spark.createDataFrame([(*row, "clash") for row in rows], SCHEMA + ", digest string"), segment_bytes=1000)
    found = {row.page_id: row for row in warc.read_archive(spark, path).collect()}
    assert {ident: row.payload.decode() for ident, row in found.items()} == {ident: html or "" for ident, _, html in rows}
    assert found[1].number > 100 and found[1].total > len(big.encode()) and found[3].number is None
    assert found[1].url == "http://a/%20b%0D%0AX:%20y"


def test_equal_payloads_are_revisits_of_the_smallest_page(spark):
    same, short = "s" * 100, "s" * 99
    rows = [(7, "a", same), (3, "b", same), (3, "b", same), (None, "c", same), (9, "d", short), (8, "e", short)]
    found = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found), key=repr)
    assert got == sorted(
        [
            (7, 100, "revisit", 3),
            (3, 100, "response", None),
            (3, 100, "revisit", 3),
            (None, 100, "revisit", 3),
            (9, 99, "response", None),
            (8, 99, "response", None),
        ],
        key=repr,
    )
    assert {r.payload_digest for r in found} == {hashlib.sha256(text.encode()).hexdigest() for text in (same, short)}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_files_are_plain_archives(spark):
    path = archive(spark, spark.createDataFrame([(1, "http://a", "hello")], SCHEMA))
    (row,) = spark.read.format("binaryFile").load(path).where("length > 40").select("content").collect()
    text = gzip.decompress(row.content)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"5\r\nhello\r\n0\r\n\r\n\r\n\r\n")


def records(*sizes: int, total: int | None = None) -> list[bytes]:
    out = []
    for number, size in enumerate(sizes, start=1):
        fields = {"WARC-Segment-Number": str(number)}
        if number > 1:
            fields["WARC-Segment-Origin-ID"] = "<a>"
        if number == len(sizes) and total is not None:
            fields["WARC-Segment-Total-Length"] = str(total)
        out.append(warc.record("response" if number == 1 else "continuation", "<a>" if number == 1 else f"<{number}>", fields, b"h\r\n\r\n"[:size]))
    return out


@pytest.mark.parametrize(("sizes", "total", "drop"), [((2, 2), 5, None), ((2, 2), None, None), ((1, 1, 1), 3, 1)])
def test_broken_segments_are_errors(spark, sizes, total, drop):
    rows = [row for number, row in enumerate(records(*sizes, total=total)) if number != drop]
    path = scratch_path(spark, "broken")
    frame = spark.createDataFrame([(row.decode(),) for row in rows], "value string").coalesce(1)
    frame.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    with pytest.raises(Exception, match="don't make up a record"):
        warc.read_archive(spark, path).collect()


def test_streams_of_several_members_and_cut_files():
    one = warc.record("response", "<a>", {}, b"x" * 3_000_000) + warc.END
    members = gzip.compress(one) + gzip.compress(one[: len(one) // 2]) + gzip.compress(one[len(one) // 2 :])
    assert [len(block) for _, block in warc.parsed(members)] == [3_000_000] * 2
    with pytest.raises(ValueError, match="shorter"):
        list(warc.parsed(gzip.compress(one[:-9])))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.parsed(gzip.compress(one + b"WARC/1.1\r\n")))
    assert list(warc.parsed(b"")) == []


def test_chunks():
    assert warc.unchunked(warc.chunked(b"abc" * 9000)) == b"abc" * 9000
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError, match="chunk"):
        warc.unchunked(b"9\r\nabc\r\n0\r\n\r\n")
