"""Looking back within a group, with and without splitting the group."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyline.functions.ordered import group_sizes, ordered_rows
from tallyline.operators import conversation
from tallyline.operators.findings import rank_findings

LIMITS = (None, 1_000_000, 10)


@pytest.fixture(scope="module")
def rows():
    """One group with a third of all rows, one null key, and many small ones."""
    random.seed(7)
    keys = ["hot"] * 200 + [None] * 60 + [f"k{random.randrange(60)}" for _ in range(340)]
    random.shuffle(keys)
    values = [random.choice([None, "a", "b", "c"]) for _ in keys]
    return [(key, place, value) for place, (key, value) in enumerate(zip(keys, values, strict=True))]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, seq int, value string")


def brute(rows):
    seen: dict = {}
    result = {}
    for key, seq, value in sorted(rows, key=lambda row: row[1]):
        before = seen.setdefault(key, [])
        last = next((v for v in reversed(before) if v is not None), None)
        result[seq] = (last, [v or "-" for v in before[-4:]], len(before) + 1)
        before.append(value)
    return result


@pytest.mark.parametrize("limit", LIMITS)
def test_looking_back(frame, rows, limit):
    found = (
        ordered_rows(frame, ["key"], [F.col("seq")], limit)
        .last_before("last", F.col("value"))
        .last_n_before("four", F.coalesce("value", F.lit("-")), 4)
        .number("place")
    )
    assert found.split is (limit == 10)
    got = {row["seq"]: (row["last"], row["four"], row["place"]) for row in found.done().collect()}
    assert got == brute(rows)


def test_group_sizes(frame):
    assert group_sizes(frame, ["key"]) == (200, 600)
    assert group_sizes(frame.limit(0), ["key"]) == (0, 0)


def test_more_blocks_for_more_rows(frame, rows):
    found = ordered_rows(frame, ["key"], [F.col("seq")], 5).number("place")
    assert found.rows.select("_block").distinct().count() > 8
    assert {row["seq"]: row["place"] for row in found.done().collect()} == {k: v[2] for k, v in brute(rows).items()}


def test_ranks_of_a_split_group(spark):
    rows = [("big", i % 50, i, "t", "o", None, ((i * 37) % 101) / 101, 0.5, 0.5, "low", [], []) for i in range(300)]
    findings = spark.createDataFrame(
        rows,
        "dataset_name string, task_no int, finding_no int, title string, observation string, metric string, "
        "impact_score double, confidence_score double, business_relevance_score double, severity string, "
        "caveats array<string>, evidence array<string>",
    )
    results = []
    for limit in LIMITS:
        ranked = rank_findings(findings, max_group_rows=limit).select("finding_no", "rank").collect()
        results.append(sorted((row["finding_no"], row["rank"]) for row in ranked))
    assert results[0] == results[1] == results[2]
    assert sorted(rank for _, rank in results[2]) == list(range(1, 301))


MESSAGES = (
    "show one row",
    "what sql did you use previously?",
    "hello there",
    "filter that to one row",
    "summarize the takeaway",
    "  ",
    "stop",
    "and again",
    "Which QUERY was used last?",
)


def replay(messages):
    """The rules message by message, with a memory per session."""
    asked: dict = {}
    for session, seq, text in sorted(messages, key=lambda row: row[1]):
        low = text.lower()
        has = {name: any(word in low for word in words) for name, words in (
            ("sql", conversation.SQL_WORDS),
            ("last", conversation.LAST_SQL_WORDS),
            ("summary", conversation.SUMMARY_WORDS),
            ("data", conversation.DATA_WORDS),
            ("back", conversation.FOLLOW_UP_WORDS),
        )}
        previous = asked.get(session)
        if not low.strip():
            mode = "error"
        elif has["sql"] and has["last"]:
            mode = "meta"
        elif has["summary"]:
            mode = "chat"
        elif has["data"] or (previous is not None and has["back"]):
            mode = "query"
        else:
            mode = "chat"
        yield (session, seq), (mode, previous)
        if mode == "query":
            asked[session] = text


@pytest.mark.parametrize("limit", LIMITS)
def test_conversation_replay(spark, limit):
    random.seed(3)
    messages = [
        (random.choice(["hot", "hot", "hot", "s1", "s2", "s3"]), seq, random.choice(MESSAGES)) for seq in range(400)
    ]
    frame = spark.createDataFrame(messages, "session string, seq int, text string")
    found = conversation.previous_queries(frame, max_group_rows=limit).collect()
    got = {(row["session"], row["seq"]): (row["mode"], row["previous_query"]) for row in found}
    assert got == dict(replay(messages))
