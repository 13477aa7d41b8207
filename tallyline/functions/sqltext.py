"""Rules over SQL texts, as column expressions, for a log of queries or for one text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.text import strip

# Fixed values.
FORBIDDEN_WORDS = (
    "insert",
    "update",
    "delete",
    "drop",
    "alter",
    "truncate",
    "grant",
    "revoke",
    "create",
    "replace",
)
SYSTEM_NAMES = ("sqlite_master", "information_schema", "pg_catalog")
LIMIT_PATTERN = r"(?i)\blimit\s+(\d+)\b"
FIRST_LIMIT_PATTERN = r"(?is)^(.*?)\blimit\s+\d+\b"
TABLE_PATTERN = r"\b(?:from|join)\s+([a-zA-Z_][\w\.]*)"
EMPTY = "SQL is empty"
MANY_STATEMENTS = "Multiple statements are not allowed"
NOT_A_QUERY = "Only SELECT/CTE queries are allowed"
FORBIDDEN_WORD = "Forbidden keyword detected: {word}"
SYSTEM_NAME = "System table/schema access blocked: {word}"
FORBIDDEN_TABLE = "Forbidden table referenced: {word}"
DISALLOWED_TABLES = "Disallowed table(s) referenced: {tables}. Use only allowed_tables."
CAPPED = "LIMIT {limit} capped to max_row_limit={cap}"


def normalize(text: Column) -> Column:
    """Trim the text, a code fence around it and a leading ``sql`` label."""
    unfenced = text
    for pattern in (r"(?i)^```sql", r"^```", r"```\z", r"(?i)^sql "):
        unfenced = F.regexp_replace(strip(unfenced), pattern, "")
    return strip(unfenced)


def stated_limit(text: Column) -> Column:
    """The number of the first LIMIT, null when there is none. One too long for the type counts as its largest."""
    digits = F.regexp_extract(text, LIMIT_PATTERN, 1)
    number = F.coalesce(digits.try_cast("decimal(38,0)"), F.lit("9" * 38).cast("decimal(38,0)"))
    return F.when(digits != "", number)


def safe_limit(row_limit: int, max_row_limit: int) -> int:
    return min(max(1, row_limit), max_row_limit)


def limited(text: Column, row_limit: int, max_row_limit: int) -> Column:
    """A struct with the text under a row limit, whether it was changed, and a warning when a limit was cut."""
    limit = stated_limit(text)
    appended = F.concat(
        F.regexp_replace(text, r";+\z", ""), F.lit(f" LIMIT {safe_limit(row_limit, max_row_limit)}")
    )
    cut = F.regexp_replace(text, FIRST_LIMIT_PATTERN, f"$1LIMIT {max_row_limit}")
    over = limit > max_row_limit
    before, after = CAPPED.format(limit="\0", cap=max_row_limit).split("\0")
    warning = F.concat(F.lit(before), limit.cast("string"), F.lit(after))
    return F.struct(
        F.when(limit.isNull(), appended).when(over, cut).otherwise(text).alias("sql"),
        (limit.isNull() | over).alias("rewritten"),
        F.when(over, warning).alias("warning"),
    )


def without_comments(text: Column) -> Column:
    """The text without line and block comments, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"--[^\n]*", ""), r"(?s)/\*.*?\*/", ""))


def table_refs(text: Column) -> Column:
    """The table names after FROM and JOIN, last part of dotted names, sorted, each once."""
    names = F.regexp_extract_all(F.lower(text), F.lit(TABLE_PATTERN), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(names, lambda name: F.substring_index(name, ".", -1))))


def guarded_words(clean: Column) -> Column:
    """The forbidden words and system names in a text, found in one search."""
    pattern = r"\b(" + "|".join((*FORBIDDEN_WORDS, *SYSTEM_NAMES)) + r")\b"
    return F.array_distinct(F.regexp_extract_all(F.lower(clean), F.lit(pattern), F.lit(1)))


def _messages(listed: Sequence[str], found: Column, template: str) -> Column:
    """A message for each listed word that was found, in the order of the list."""
    before, after = template.split("{word}")
    present = F.filter(F.lit(list(listed)), lambda word: F.array_contains(found, word))
    return F.transform(present, lambda word: F.concat(F.lit(before), word, F.lit(after)))


def problems(
    clean: Column,
    words: Column,
    refs: Column,
    forbidden_tables: Sequence[str] = (),
    allowed_tables: Sequence[str] = (),
) -> Column:
    """The reasons to refuse a text, in the order of the rules; an empty array lets it pass.

    Takes the text without comments, its ``guarded_words`` and its ``table_refs``.
    """
    one = F.regexp_replace(clean, r"\s*;\z", "")
    kind = F.array_compact(
        F.array(
            F.when(one.contains(";"), F.lit(MANY_STATEMENTS)),
            F.when(~clean.rlike(r"(?i)^(select|with)"), F.lit(NOT_A_QUERY)),
        )
    )
    parts = [kind, _messages(FORBIDDEN_WORDS, words, FORBIDDEN_WORD), _messages(SYSTEM_NAMES, words, SYSTEM_NAME)]
    if forbidden_tables:
        tables = [table.lower() for table in forbidden_tables]
        parts.append(_messages(tables, refs, FORBIDDEN_TABLE))
    if allowed_tables:
        others = F.array_except(refs, F.lit([table.lower() for table in allowed_tables]))
        before, after = DISALLOWED_TABLES.split("{tables}")
        listed = F.concat(F.lit(before), F.array_join(others, ", "), F.lit(after))
        parts.append(F.when(F.size(others) > 0, F.array(listed)).otherwise(F.array().cast("array<string>")))
    return F.when(clean == "", F.array(F.lit(EMPTY))).otherwise(F.concat(*parts))
