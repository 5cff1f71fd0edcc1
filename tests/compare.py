"""Spark results against their SQL twins in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    out = frame[sorted(frame.columns)].copy()
    for name in out.columns:
        col = out[name]
        if str(col.dtype).startswith("datetime64"):
            out[name] = col.astype("datetime64[us]").astype("string")
        elif col.dtype == object or str(col.dtype) in ("str", "string"):
            out[name] = col.astype("string")
    out = out.fillna("<null>") if not out.empty else out
    return out.sort_values(list(out.columns), kind="stable").reset_index(drop=True)


def difference(spark_frame: pd.DataFrame, twin_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(twin_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(twin_frame.columns)}"
    if len(spark_frame) != len(twin_frame):
        return f"{len(spark_frame)} and {len(twin_frame)} rows"
    a, b = canonical(spark_frame), canonical(twin_frame)
    for name in a.columns:
        if str(a[name].dtype) != str(b[name].dtype):
            return f"column {name}: {a[name].dtype} and {b[name].dtype}"
        if not a[name].equals(b[name]):
            at = (a[name] != b[name]).idxmax()
            return f"column {name}, row {at}: {a.loc[at].to_dict()} and {b.loc[at].to_dict()}"
    return None
