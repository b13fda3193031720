"""Compares a query with its DuckDB text on one directory of tables, order aside."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def duck(sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con.sql(sql).df()


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(
        tuple("" if pd.isna(v) else (f"{v:.6g}" if isinstance(v, float) else str(v)) for v in r)
        for r in df[cols].astype(object).itertuples(index=False)
    )
