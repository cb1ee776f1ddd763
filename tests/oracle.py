"""Spark's rows against DuckDB's."""

import math
from pathlib import Path

import duckdb
import pandas as pd


def rows(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, numbers alike whatever their type, in a fixed order."""

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return ""
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


def duck(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con.execute(sql).df()
