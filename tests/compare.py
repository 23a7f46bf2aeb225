"""Rows of a Spark query and of its oracle in DuckDB, in one canonical form."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb


def canonical(value) -> str:
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        number = float(value)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else f"{number:.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return str(value)


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("\x1f".join(canonical(row[i]) for i in order) for row in rows)


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    found = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        found.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return found


def check(query, sql: str, spark, folder: str) -> None:
    df = query(spark, folder)
    ours = rows_of(df.columns, df.collect())
    result = connection(folder).sql(sql)
    theirs = rows_of(result.columns, result.fetchall())
    assert sorted(df.columns) == sorted(result.columns)
    assert ours == theirs
