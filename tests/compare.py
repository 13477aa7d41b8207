"""Comparing a Spark result with DuckDB, column by column, whatever the row order."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def normal(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return value


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(normal(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(body, key=repr)


def spark_table(frame) -> tuple[list[str], list[tuple]]:
    return table(frame.columns, frame.collect())


def duck_table(connection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    return table([entry[0] for entry in cursor.description], cursor.fetchall())


def differences(ours, theirs, show: int = 4) -> list[str]:
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} / {theirs[0]}"]
    if len(ours[1]) != len(theirs[1]):
        return [f"rows {len(ours[1])} / {len(theirs[1])}", *map(repr, ours[1][:2]), *map(repr, theirs[1][:2])]
    return [f"{a!r}\n    {b!r}" for a, b in zip(ours[1], theirs[1], strict=True) if a != b][:show]
