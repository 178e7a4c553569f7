"""Holds a query's rows against its DuckDB SQL, in any order; floats to nine places."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def _value(x):
    if isinstance(x, float):
        return round(x, 9) + 0.0 if x == x else None
    if hasattr(x, "isoformat"):
        return x.replace(tzinfo=None).isoformat()
    return x


def differences(spark, f, sql: str, sf_dir: str) -> str:
    df = f(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(_value(r[n]) for n in names) for r in df.collect())
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = c.execute(sql)
    cols = [x[0] for x in r.description]
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    want = Counter(tuple(_value(row[cols.index(n)]) for n in names) for row in r.fetchall())
    return "" if got == want else f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}, only there {list((want - got).items())[:3]}"
