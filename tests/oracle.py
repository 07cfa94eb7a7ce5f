"""Run one registered query in Spark and in DuckDB and compare the rows."""

from __future__ import annotations

import decimal
import math
import pathlib

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(pathlib.Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str) -> tuple[int, list[str]]:
    """Row count and a list of differences (empty when equal)."""
    df = fn(spark, sf_dir)
    got_columns = df.columns
    got = rows_of(got_columns, df.collect())
    found = con.execute(sql)
    want_columns = [d[0] for d in found.description]
    want = rows_of(want_columns, found.fetchall())
    problems = []
    if sorted(got_columns) != sorted(want_columns):
        problems.append(f"columns {sorted(got_columns)} != {sorted(want_columns)}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        extra = sorted(set(got) - set(want))[:3]
        missing = sorted(set(want) - set(got))[:3]
        problems.append(f"only spark {str(extra)[:600]}\nonly sql {str(missing)[:600]}")
    return len(got), problems
