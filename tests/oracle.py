"""Compares a query's rows with its SQL's on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def sql_rows(sql: str, folder: str) -> pd.DataFrame:
    db = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        db.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return db.execute(sql).df()


def as_rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)

    def plain(x):
        if x is None or (not isinstance(x, (list, tuple)) and pd.isna(x)):
            return "null"
        if isinstance(x, float) and not x.is_integer():
            return f"{x:.6f}"
        return str(int(x)) if isinstance(x, (bool, float)) else str(x)

    return sorted(tuple(plain(x) for x in row) for row in frame[names].astype(object).itertuples(index=False))
