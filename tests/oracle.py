"""Spark results held against DuckDB's on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)[:26] if hasattr(v, "isoformat") else v


def same_rows(found, sf_dir: str, sql: str) -> None:
    columns, rows = duck(sf_dir, sql)
    assert sorted(found.columns) == sorted(columns)
    names = sorted(columns)
    ours = sorted(repr([plain(r[n]) for n in names]) for r in found.collect())
    theirs = sorted(repr([plain(dict(zip(columns, r))[n]) for n in names]) for r in rows)
    assert ours == theirs
