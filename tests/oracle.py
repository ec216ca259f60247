"""Runs a query and its SQL over the same tables and compares them as multisets of rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings sources crawled_pages code_examples search_metrics eval_items moderation_samples".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _value(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, dict):
        return tuple((k, _value(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, _value(x)) for k, x in v.asDict().items())
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows(names: list[str], data: list[tuple]) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(_value(r[i]) for i in order)) for r in data)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None."""
    got = spark_df.collect()
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    a, b = rows(spark_df.columns, [tuple(r) for r in got]), rows(names, want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; only Spark: {sorted(set(a) - set(b))[:2]}; only SQL: {sorted(set(b) - set(a))[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ: {bad[0]}" if bad else None
