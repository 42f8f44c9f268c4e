"""Side-by-side check of the registered queries against their SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _canonical(rows, columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return repr(round(v, 9)) if isinstance(v, float) else repr(v)

    return sorted(tuple(value(row[i]) for i in order) for row in rows)


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), _canonical(df.collect(), df.columns)


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), _canonical(cur.fetchall(), columns)


def difference(df: DataFrame, con, sql: str) -> str | None:
    """None when equal, otherwise a short description."""
    got_columns, got = spark_rows(df)
    want_columns, want = sql_rows(con, sql)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:2]
    lost = [r for r in want if r not in set(got)][:2]
    return f"{len(got)} rows vs {len(want)}; only spark {extra}; only sql {lost}"
