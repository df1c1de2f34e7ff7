"""Comparison of a query's rows with DuckDB's."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}/*.parquet" if os.path.isdir(f"{folder}/{name}") else f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def one(x):
        if hasattr(x, "__len__") and not isinstance(x, str):
            return str(list(x))
        if pd.isna(x):
            return "null"
        return f"{float(x):.6g}" if isinstance(x, (float, int)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(one(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False))
