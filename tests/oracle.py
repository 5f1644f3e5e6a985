"""Spark results against SQL run by DuckDB on the same files."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql: str, folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con.sql(sql).df()


def canonical(pdf):
    cols = sorted(pdf.columns)
    out = pdf[cols].copy()
    for c in cols:
        out[c] = out[c].map(lambda v: "null" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v))
    return cols, sorted(map(tuple, out.to_numpy().tolist()))


def assert_same(df, sql: str, folder: str) -> None:
    got, want = canonical(df.toPandas()), canonical(rows_of(sql, folder))
    assert got[0] == want[0]
    assert got[1] == want[1]
