"""Running a query in Spark and its SQL in DuckDB, as bags of rows."""

from __future__ import annotations

import os
from collections import Counter
from glob import glob

import duckdb


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def spark_rows(df) -> Counter:
    cols = sorted(df.columns)
    return Counter(repr(tuple(map(norm, r))) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def duck_rows(sql: str, folder: str, columns: list[str]) -> Counter:
    con = duckdb.connect()
    for p in glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in sorted(columns)]
    return Counter(repr(tuple(norm(row[i]) for i in at)) for row in r.fetchall())
