"""Compares a query with its DuckDB oracle on the driver's tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).iterdir():
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"create view {path.stem} as select * from read_parquet('{files}')")
    return con


def rows(frame):
    plain = frame[sorted(frame.columns)].astype(object)
    return Counter(tuple(None if pd.isna(x) else float(x) if isinstance(x, float) else x for x in r) for r in plain.itertuples(index=False, name=None))


def same(spark, query, sql, sf_dir):
    ours, theirs = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
