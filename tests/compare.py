"""Compare a Spark result with its SQL twin run by DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(int(v))
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(0.0 if v == 0 else v) if v != int(v) else repr(int(v)) if abs(v) < 1e15 else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql, show=3):
    """Empty list when equal; else short texts that say what differs."""
    cols, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    ocols, orows = canonical([d[0] for d in res.description], res.fetchall())
    out = []
    if cols != ocols:
        out.append(f"columns {cols} != {ocols}")
    if len(rows) != len(orows):
        out.append(f"rows {len(rows)} != {len(orows)}")
    if not out and rows != orows:
        a, b = set(rows), set(orows)
        out.append(f"values differ: spark only {sorted(a - b)[:show]} | sql only {sorted(b - a)[:show]}")
    return out
