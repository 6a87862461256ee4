"""Holds a query against its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def both(spark, query, sql: str, sf: str = SF) -> tuple[list, list]:
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(_plain(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    return sorted(got, key=str), sorted(want, key=str)
