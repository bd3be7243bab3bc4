"""Spark's rows against DuckDB's, regardless of order."""

from pathlib import Path

import duckdb
import pandas as pd


def tables(sf_dir):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return sorted(
        (tuple(None if x is pd.NA or x is None or x != x else x + 0.0 if isinstance(x, float) else x for x in r) for r in df[columns].astype(object).itertuples(index=False)),
        key=repr,
    )


def same(spark_df, con, sql):
    mine, theirs = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = rows(mine), rows(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
