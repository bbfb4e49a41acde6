"""DuckDB beside Spark on the same Parquet files."""

import glob
import os

import duckdb
import pandas as pd


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if hasattr(v, "item"):
            v = v.item()
        return repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    cols = sorted(df.columns)
    return sorted(tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False))


def run(sql: str, folder: str | None = None, **frames) -> pd.DataFrame:
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet") if folder else []:
        name = os.path.basename(p)[:-8]
        if name not in frames:
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}'")
    for name, f in frames.items():
        c.register(name, f)
    return c.execute(sql).df()


def same(spark_df, sql: str, folder: str) -> None:
    got, want = spark_df.toPandas(), run(sql, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
