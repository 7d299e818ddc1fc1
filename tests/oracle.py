"""Rows of a query against those of its SQL in DuckDB."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        where = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{where}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def assert_same(df, sql: str, sf_dir: str) -> None:
    columns = sorted(df.columns)
    found = connect(sf_dir).sql(sql)
    assert sorted(found.columns) == columns
    ours = Counter(tuple(plain(row[c]) for c in columns) for row in df.collect())
    theirs = Counter(tuple(map(plain, row)) for row in found.select(*[f'"{c}"' for c in columns]).fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
