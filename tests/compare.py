"""Holds a query's result against the SQL that says the same, over the test tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if path.is_file() else path / '*.parquet'}')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__module__ == "decimal":
        return "None" if math.isnan(v) else f"{float(v):.6f}".replace("-0.000000", "0.000000")
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def assert_same(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    result = con.sql(sql)
    assert sorted(df.columns) == sorted(result.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(result.columns, result.fetchall())
