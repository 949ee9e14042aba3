"""Comparison of a query with its SQL on DuckDB."""

import decimal
import os
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.number, decimal.Decimal)):
        return round(float(x), 6)
    return str(x)


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(_cell, r))) for r in frame.itertuples(index=False))


def duck(sql: str, folder: str = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con.execute(sql).df()


def check(spark, registry, name: str, folder: str = DATA) -> None:
    got = registry.queries[name](spark, folder).toPandas()
    want = duck(registry.sql[name], folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
