from __future__ import annotations

import re

import pytest
import xxhash
from conftest import load

from tallyline.llm import near_dedup
from tallyline.llm.components import components
from tallyline.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text: str | None) -> int:
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashed = [xxhash.xxh64_intdigest(run, 42) for run in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashed) > len(hashed))


def brute_components(prints: list[int]) -> dict[int, int]:
    distinct = sorted(set(prints))
    label = {fp: fp for fp in distinct}

    def root(fp):
        while label[fp] != fp:
            fp = label[fp]
        return fp

    for place, a in enumerate(distinct):
        for b in distinct[:place]:
            if (a ^ b).bit_count() <= 3:
                label[root(a)] = root(b)
    return {fp: root(fp) for fp in distinct}


def brute(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    prints = [brute_fingerprint(text) for _, text in rows]
    parts = brute_components(prints)
    least: dict[int, int] = {}
    for (ident, _), fp in zip(rows, prints, strict=True):
        if ident is not None:
            least[parts[fp]] = min(ident, least.get(parts[fp], ident))
    return sorted(((i, f"{fp:016x}", least.get(parts[fp])) for (i, _), fp in zip(rows, prints, strict=True)), key=repr)


def test_query_agrees_with_all_pairs(spark):
    from conftest import SF_DIR

    rows = [tuple(row) for row in load(spark, "documents").select("doc_id", "text").collect()]
    found = sorted((tuple(row) for row in QUERIES["op3_simhash_dedup"](spark, SF_DIR).collect()), key=repr)
    assert found == brute(rows)


@pytest.mark.parametrize("heavy", [0, 2, 64])
def test_near_copies_link_the_same_with_crowded_halves(spark, heavy):
    base = 0x0123456789ABCDEF
    prints = {base}
    for a in range(0, 64, 3):
        prints |= {base ^ 1 << a, base ^ 1 << a ^ 1 << (a * 7 + 5) % 64, base ^ 7 << a & (1 << 64) - 1, base ^ 0x1F << a & (1 << 64) - 1}
    signed = [fp - (1 << 64) if fp >> 63 else fp for fp in prints]
    frame = spark.createDataFrame([(fp,) for fp in signed], "fp long")
    linked = {row.node: row.component for row in components(near_dedup.links(frame, heavy)).collect()}
    ours = {fp: linked.get(s, s) for fp, s in zip(prints, signed, strict=True)}
    theirs = brute_components(list(prints))
    assert {frozenset(f for f in prints if ours[f] == ours[g]) for g in prints} == {
        frozenset(f for f in prints if theirs[f] == theirs[g]) for g in prints
    }


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "a  B"), (4, "a  B"), (5, "x " * 5000), (None, "lonely words here only"), (7, "é à\x00 ü")]
    frame = spark.createDataFrame([(*row, "clash", 3) for row in rows], SCHEMA + ", fingerprint string, fp int")
    found = near_dedup.group(frame)
    got = sorted(((r.row.doc_id, f"{r.fingerprint & (1 << 64) - 1:016x}", r.component_id) for r in found.collect()), key=repr)
    assert got == brute(rows)
    kept = [row.doc_id for row in found.where("first").select("row.*").collect()]
    assert sorted(kept, key=repr) == [1, 4, 5, 7, None]


def test_empty_table(spark):
    assert near_dedup.group(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (None, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert set(found) == set(range(100, 161)) | set(range(1000, 1200))
    assert all(found[i] == (100 if i < 1000 else 1000) for i in found)
