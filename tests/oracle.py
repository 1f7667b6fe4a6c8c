"""Runs a query and its SQL over the same tables and compares all rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else str(round(v, 6))
    return str(v.tolist() if hasattr(v, "tolist") else v)


def rows(df: pd.DataFrame, columns: list[str]) -> list[str]:
    return sorted(repr([plain(v) for v in row]) for row in df[columns].astype(object).values.tolist())


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def agree(spark, sf_dir: str, query, sql: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
