"""DuckDB side of query tests."""

import decimal
import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if hasattr(v, "item"):
        return plain(v.item())
    if hasattr(v, "isoformat"):
        return str(v)[:26].replace("T", " ").removesuffix(" 00:00:00")
    return v


def rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(plain, r)) for r in df[cols].astype(object).itertuples(index=False)), key=repr)
