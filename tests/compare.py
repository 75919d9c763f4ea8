"""Spark results against DuckDB's, in any order of rows and columns."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v: object) -> object:
    if isinstance(v, Decimal):
        raise AssertionError("a decimal where a double is meant")
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    rows = rel.select(*[f'"{c}"' for c in cols]).fetchall()
    return cols, sorted((tuple(plain(x) for x in r) for r in rows), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)


def agree(df, sf_dir: str, sql: str) -> int:
    """Asserts that both give the same; the number of rows."""
    ours, theirs = spark_rows(df), duck(sf_dir, sql)
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    for a, b in zip(ours[1], theirs[1], strict=True):
        assert a == b
    return len(ours[1])
