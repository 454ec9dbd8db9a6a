"""Comparing a query with its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def _text(value: object) -> str:
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def spark_rows(df) -> tuple[list[str], list[tuple[str, ...]]]:
    names = sorted(df.columns)
    return names, sorted(tuple(_text(r[c]) for c in names) for r in df.collect())


def duckdb_rows(con, sql: str) -> tuple[list[str], list[tuple[str, ...]]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_text(row[i]) for i in order) for row in cursor.fetchall())
