"""Runs a query and its SQL over the same tables and compares rows, whatever their order."""

from __future__ import annotations

import math
import os

import duckdb

SF = os.environ.get("GLEANER_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if hasattr(x, "item"):
        return normal(x.item())
    if isinstance(x, (list, tuple)):
        return tuple(map(normal, x))
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(normal(r[k]) for k in order) for r in rows), key=repr)


def differences(spark, query, sql, sf=SF) -> str:
    """Empty if both give the same; else what differs."""
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = query(spark, sf)
    want = db.execute(sql)
    columns = [d[0] for d in want.description]
    if sorted(got.columns) != sorted(columns):
        return f"columns {sorted(got.columns)} and {sorted(columns)}"
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(columns, want.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""
