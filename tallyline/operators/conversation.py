"""Rules over conversation logs: one row per user message, ordered within its session.

The rules of one message are substring tests. What a message owes to earlier ones of its session is looked up along
the order, also when a single session holds a large part of the log (see ``functions.ordered``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.metrics import column
from tallyline.functions.ordered import MAX_GROUP_ROWS, OrderedRows, ordered_rows
from tallyline.functions.text import contains_any, fill, strip

# Word lists.
SQL_WORDS = ("sql", "query")
LAST_SQL_WORDS = ("last", "previous", "that", "generated", "used", "use", "show")
SUMMARY_WORDS = ("summary", "summarize", "takeaway", "recommend", "recommendation", "insight")
DATA_WORDS = (
    "top",
    "count",
    "sum",
    "avg",
    "average",
    "revenue",
    "sales",
    "customer",
    "orders",
    "list",
    "show",
    "compare",
    "trend",
    "how many",
    "what",
    "which",
)
FOLLOW_UP_WORDS = ("that", "those", "them", "same", "again", "previous", "above")

# Replies and note formats.
NO_PREVIOUS_SQL = "No previous SQL in this session yet."
PREVIOUS_SQL = "Here is the SQL from your previous query."
FIRST_CHAT = "I can help you analyze your data. Ask a question like 'Top customers by revenue in the last 30 days'. {hint}"
NO_HINT = "No semantic metadata loaded."
HINTS = ("Preferred views: {names}.", "Metrics: {names}.", "Dimensions: {names}.")
HINTED_NAMES = 4
NO_RESULT_ROWS = "I ran the query successfully, but it returned no rows."
FIRST_ROW = " First row preview: {row}"
SUGGESTED = " Suggested follow-ups: {suggestions}"
BREAK_DOWN = "break down {metric} by {dimension}"
COMPARE = "compare {metric} vs previous period"
NO_SUGGESTION = "ask for a trend over time"
NEXT_CHAT = (
    "I can continue from the last result. Ask for filters, breakdowns, comparisons, or ask for the previous SQL."
)
FOLLOW_UP_CONTEXT = (
    "Use this previous context to resolve references.\n"
    "Previous question: {question}\n"
    "Previous SQL: {sql}\n"
    "Follow-up question: {message}"
)
HISTORY_TURNS = 4
HISTORY_TURN = "User: {user}\nAssistant: {assistant}"
NO_HISTORY = "No previous turns."
NOTE_HEADING = "# Conversation Notes: {session}\n\n_Created: {at}_\n\n"
NOTE_TURN = "## Turn ({at})\n\n- Mode: `{mode}`\n- User: {user}\n\n### Assistant\n\n{assistant}\n\n"
NOTE_SQL = "### SQL\n\n```sql\n{sql}\n```\n\n"
DEFAULT_NOTE = "default"


def _tests(text: Column) -> dict[str, Column]:
    """What the words of one message say, whatever came before."""
    return {
        "_blank": strip(text) == "",
        "_last_sql": contains_any(text, SQL_WORDS) & contains_any(text, LAST_SQL_WORDS),
        "_summary": contains_any(text, SUMMARY_WORDS),
        "_data": contains_any(text, DATA_WORDS),
        "_refers": contains_any(text, FOLLOW_UP_WORDS),
    }


def _mode(has_query: Column) -> Column:
    """The mode of a message from its tests and from whether an earlier message of the session was a query."""
    return (
        F.when(F.col("_blank"), "error")
        .when(F.col("_last_sql"), "meta")
        .when(F.col("_summary"), "chat")
        .when(F.col("_data") | (F.col("_refers") & has_query), "query")
        .otherwise("chat")
    )


def _with_modes(rows: OrderedRows, text: str, known: str | None = None) -> OrderedRows:
    """Add the mode, and keep the test of referring back in ``_refers``.

    A follow-up needs an earlier query, and the first query of a session needs words of its own, so an earlier
    message that is a query by its own words is the same as an earlier query. Rows marked in the ``known`` column are
    queries already.
    """
    tests = _tests(column(text))
    tested = replace(rows, rows=rows.rows.withColumns(tests))
    marked = F.lit(False) if known is None else F.coalesce(column(known), F.lit(False))
    opens = marked | (~F.col("_last_sql") & ~F.col("_summary") & F.col("_data"))
    opened = tested.last_before("_opened", F.when(opens, F.lit(True)))
    decided = F.when(marked, "query").otherwise(_mode(F.coalesce("_opened", F.lit(False))))
    unused = [name for name in tests if name != "_refers"]
    return replace(opened, rows=opened.rows.withColumn("mode", decided).drop("_opened", *unused))


def _rows(
    messages: DataFrame,
    session: Sequence[str],
    seq: str,
    max_group_rows: int | None,
    count_in: DataFrame | None = None,
) -> OrderedRows:
    return ordered_rows(messages, session, [column(seq)], max_group_rows, count_in)


def conversation_modes(
    messages: DataFrame,
    session: Sequence[str] = ("session",),
    seq: str = "seq",
    text: str = "text",
    max_group_rows: int | None = MAX_GROUP_ROWS,
    count_in: DataFrame | None = None,
) -> DataFrame:
    """Add ``mode``: query, meta, chat, or error for a blank message."""
    return _with_modes(_rows(messages, session, seq, max_group_rows, count_in), text).done().drop("_refers")


def semantic_hint(metrics: Sequence[str] = (), dimensions: Sequence[str] = (), views: Sequence[str] = ()) -> str:
    """What a first reply says about the data: all preferred views and the first metrics and dimensions."""
    named = zip(HINTS, (views, metrics[:HINTED_NAMES], dimensions[:HINTED_NAMES]), strict=True)
    return " ".join(text.format(names=", ".join(names)) for text, names in named if names) or NO_HINT


def suggestions(columns: Column, metrics: Sequence[str] = (), dimensions: Sequence[str] = ()) -> Column:
    """What to ask after a result with these columns; the first names of a model stand in for what it lacks."""

    def chosen(names: Sequence[str]) -> Column:
        if not names:
            return F.lit(None).cast("string")
        present = F.filter(F.array(*map(F.lit, names)), lambda name: F.array_contains(columns, name))
        return F.coalesce(F.get(present, F.lit(0)), F.lit(names[0]))

    metric, dimension = chosen(metrics), chosen(dimensions)
    broken_down = F.when(metric.isNotNull() & dimension.isNotNull(), fill(BREAK_DOWN, metric=metric, dimension=dimension))
    compared = F.when(metric.isNotNull(), fill(COMPARE, metric=metric))
    return F.coalesce(F.nullif(F.concat_ws("; ", broken_down, compared), F.lit("")), F.lit(NO_SUGGESTION))


def query_replies(results: DataFrame, metrics: Sequence[str] = (), dimensions: Sequence[str] = ()) -> DataFrame:
    """Add the ``reply`` to answered queries with ``summary``, ``row_count``, ``columns`` and ``first_row`` (text).

    A null row count counts as rows; null columns or a null first row have no preview.
    """
    columns = F.coalesce("columns", F.array().cast("array<string>"))
    preview = F.when((F.size(columns) > 0) & F.col("first_row").isNotNull(), fill(FIRST_ROW, row=F.col("first_row")))
    follow = fill(SUGGESTED, suggestions=suggestions(columns, metrics, dimensions))
    found = F.concat(F.coalesce("summary", F.lit("")), F.coalesce(preview, F.lit("")), follow)
    return results.withColumn("reply", F.when(F.col("row_count") == 0, NO_RESULT_ROWS).otherwise(found))


def previous_queries(
    messages: DataFrame,
    session: Sequence[str] = ("session",),
    seq: str = "seq",
    text: str = "text",
    sql: str | None = None,
    known: str | None = None,
    max_group_rows: int | None = MAX_GROUP_ROWS,
    count_in: DataFrame | None = None,
    hint: str = NO_HINT,
) -> DataFrame:
    """Add ``mode``, ``previous_query`` and ``reply``, and ``previous_sql`` when the log has a SQL column.

    ``reply`` is the fixed answer to meta and chat messages, the first one with a ``semantic_hint``; ``query_replies``
    answers queries.
    """
    found = _previous_queries(messages, session, seq, text, sql, known, max_group_rows, count_in, hint)
    return found.drop("_refers")


def _previous_queries(
    messages: DataFrame,
    session: Sequence[str],
    seq: str,
    text: str,
    sql: str | None,
    known: str | None,
    max_group_rows: int | None,
    count_in: DataFrame | None = None,
    hint: str = NO_HINT,
) -> DataFrame:
    rows = _with_modes(_rows(messages, session, seq, max_group_rows, count_in), text, known)
    asked = {"previous_query": column(text), **({"previous_sql": column(sql)} if sql is not None else {})}
    query = F.struct(*[value.alias(name) for name, value in asked.items()])
    found = rows.last_before("_previous", F.when(F.col("mode") == "query", query)).done()
    found = found.withColumns({name: F.col("_previous")[name] for name in asked}).drop("_previous")
    fresh = F.col("previous_query").isNull()
    reply = (
        F.when(F.col("mode") == "meta", F.when(fresh, NO_PREVIOUS_SQL).otherwise(PREVIOUS_SQL))
        .when(F.col("mode") == "chat", F.when(fresh, FIRST_CHAT.format(hint=hint)).otherwise(NEXT_CHAT))
        .otherwise(F.lit(None).cast("string"))
    )
    return found.withColumn("reply", reply)


def resolve_follow_ups(
    messages: DataFrame,
    session: Sequence[str] = ("session",),
    seq: str = "seq",
    text: str = "text",
    sql: str | None = None,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``resolved``: a query that refers back gets the previous question and SQL in front.

    The previous question is the message as written, not its own resolved form.
    """
    found = _previous_queries(messages, session, seq, text, sql, None, max_group_rows)
    refers = F.col("_refers") & F.col("previous_query").isNotNull()
    context = fill(
        FOLLOW_UP_CONTEXT,
        question=F.col("previous_query"),
        sql=F.col("previous_sql") if sql is not None else F.lit(None),
        message=column(text),
    )
    resolved = F.when((F.col("mode") == "query") & refers, context).otherwise(column(text))
    return found.withColumn("resolved", resolved).drop("_refers")


def pair_turns(log: DataFrame, session: str, seq: str, role: str, text: str) -> DataFrame:
    """One row per user message with the assistant message that directly follows: ``user, assistant``."""
    users = log.filter(column(role) == "user").select(session, seq, column(text).alias("user"))
    replies = log.filter(column(role) == "assistant").select(
        column(session).alias("_session"), (column(seq) - 1).alias("_seq"), column(text).alias("assistant")
    )
    match = (column(session) == F.col("_session")) & (column(seq) == F.col("_seq"))
    return users.join(replies, match, "left").drop("_session", "_seq")


def recent_history(
    turns: DataFrame,
    session: Sequence[str] = ("session",),
    seq: str = "seq",
    user: str = "user",
    assistant: str = "assistant",
    n: int = HISTORY_TURNS,
    max_group_rows: int | None = MAX_GROUP_ROWS,
    count_in: DataFrame | None = None,
) -> DataFrame:
    """Add ``history``: the turns just before, oldest first. ``count_in`` is as in ``ordered_rows``."""
    turn = fill(HISTORY_TURN, user=column(user), assistant=column(assistant))
    rows = _rows(turns, session, seq, max_group_rows, count_in).last_n_before("_turns", turn, n)
    history = F.when(F.size("_turns") > 0, F.array_join("_turns", "\n")).otherwise(NO_HISTORY)
    return rows.done().withColumn("history", history).drop("_turns")


def note_file(session: Column) -> Column:
    """The file name of a session's notes."""
    name = F.regexp_replace(session.cast("string"), r"[^A-Za-z0-9._-]+", "_")
    name = F.regexp_replace(name, r"^[._]+|[._]+$", "")
    return F.concat(F.when(name == "", F.lit(DEFAULT_NOTE)).otherwise(name), F.lit(".md"))


def conversation_notes(
    turns: DataFrame,
    session: str = "session",
    seq: str = "seq",
    user: str = "user",
    assistant: str = "assistant",
    mode: str = "mode",
    sql: str | None = None,
    at: str | None = None,
    max_group_rows: int | None = MAX_GROUP_ROWS,
    count_in: DataFrame | None = None,
) -> DataFrame:
    """One Markdown block per turn: ``file_name, turn_no, note``; the first of a session starts with its heading.

    The blocks of a file stay separate rows, since a single session may be too large for one row. Times come from the
    ``at`` column, or else the place in the session stands for them.
    """
    stamp = column(at if at is not None else seq)
    block = fill(
        NOTE_TURN, at=stamp, mode=column(mode), user=column(user), assistant=F.coalesce(column(assistant), F.lit(""))
    )
    if sql is not None:
        has_sql = F.coalesce(column(sql), F.lit("")) != ""
        block = F.concat(block, F.when(has_sql, fill(NOTE_SQL, sql=column(sql))).otherwise(""))
    heading = F.when(F.col("turn_no") == 1, fill(NOTE_HEADING, session=column(session), at=stamp)).otherwise("")
    rows = _rows(turns, [session], seq, max_group_rows, count_in).number("turn_no").done()
    return rows.select(
        column(session),
        note_file(column(session)).alias("file_name"),
        F.col("turn_no").cast("bigint").alias("turn_no"),
        F.concat(heading, block).alias("note"),
    )


def write_notes(notes: DataFrame, path: str, session: str = "session") -> None:
    """Write the notes as text, one folder per file name, in part files whose names follow the turns."""
    order = ["file_name", session, "turn_no"]
    (
        notes.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("file_name", F.regexp_replace("note", r"\n\z", "").alias("note"))  # the writer ends each row's line
        .write.mode("overwrite")
        .partitionBy("file_name")
        .text(path)
    )
