"""Compare a query with its SQL: columns by name, rows in any order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    clean = lambda v: round(v, 5) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    return [names[k] for k in order], Counter(tuple(clean(r[k]) for k in order) for r in rows)


def against_sql(df, sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    want = rows_of([d[0] for d in found.description], found.fetchall())
    return rows_of(df.columns, [tuple(r) for r in df.collect()]), want
