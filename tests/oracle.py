"""Compares a query with its DuckDB twin: rows as multisets of texts, columns by name."""

import os
from numbers import Number

import duckdb
import pandas as pd


def text(v) -> str:
    if hasattr(v, "__iter__") and not isinstance(v, str):
        return str(list(v))
    if pd.isna(v):
        return "<null>"
    return repr(float(v)) if isinstance(v, Number) and not isinstance(v, bool) else str(v)


def rows(df) -> list[tuple[str, ...]]:
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con.execute(sql).df()


def check(df, sql: str, sf_dir: str) -> None:
    ours, theirs = df.toPandas(), duck(sql, sf_dir)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
