"""Compares a query with its SQL on the smallest tables, or others."""

from __future__ import annotations

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(_plain, v)) if isinstance(v, list) else v


def assert_same(spark, query, sql: str, sf: str = SF) -> None:
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = query(spark, sf)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    ours = sorted((tuple(_plain(r[c]) for c in order) for r in got.collect()), key=repr)
    at = [names.index(c) for c in order]
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    assert ours == theirs
