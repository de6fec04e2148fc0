"""Runs a query on Spark and its SQL twin on the same files and lists the differences."""

from __future__ import annotations

import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def run_pair(spark, con, name, queries, oracles, sf_dir):
    """Returns (problem or None, Spark rows, Spark seconds)."""
    start = time.time()
    df = queries[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in oracles:
        return (None if rows else "no rows"), len(rows), took
    result = con.sql(oracles[name])
    columns, types = result.columns, [str(t) for t in result.types]
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(rows), took
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    spark_types = {c: kinds.get(t, t) for c, t in df.dtypes}
    for c, t in zip(columns, types):
        if spark_types[c] != t:
            return f"type of {c}: {spark_types[c]} != {t}", len(rows), took
    mine, theirs = _rows(df.columns, rows), _rows(columns, expected)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}", len(rows), took
    for a, b in zip(mine, theirs):
        if a != b or repr(a) != repr(b):
            return f"{sorted(columns)}: {a} != {b}", len(rows), took
    return None, len(rows), took
