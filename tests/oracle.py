"""Runs a query and its SQL side by side."""

from __future__ import annotations

from numbers import Number
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(x: object) -> object:
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, Number) and not isinstance(x, (bool, np.bool_)):
            return f"{float(x) + 0.0:.6f}"
        return str(pd.Timestamp(x)) if hasattr(x, "isoformat") else str(x)

    return sorted(tuple(value(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def from_sql(sql: str, sf_dir: str = SF) -> pd.DataFrame:
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        for path in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        return con.execute(sql).df()
