"""Comparison of a query with its oracle."""

import os

import duckdb
import pandas as pd


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        cells = []
        for x in row:
            if x is None or x is pd.NA or (isinstance(x, float) and x != x):
                cells.append(None)
            elif isinstance(x, bool) or type(x).__name__ in ("bool", "bool_"):
                cells.append(bool(x))
            elif hasattr(x, "dtype") or isinstance(x, (int, float)):
                cells.append(round(float(x), 5))
            else:
                cells.append(str(x))
        out.append(tuple(cells))
    return sorted(out, key=repr)


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con.sql(sql).df()
