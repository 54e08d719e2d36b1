"""Compares a query with its SQL in DuckDB over the smallest tables."""

import os

import duckdb
import pandas as pd

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        return round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


def compare(spark, query, sql: str) -> None:
    con = duckdb.connect()
    for p in os.listdir(SF_DIR):
        con.execute(f"create view {p.split('.')[0]} as select * from '{SF_DIR}/{p}'")
    want, got = con.execute(sql).df(), query(spark, SF_DIR).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want)
