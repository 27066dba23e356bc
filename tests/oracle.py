"""Side-by-side run of a query and its SQL: rows as sorted tuples of normalised values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else round(float(v), 9)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v.is_integer() and abs(v) < 2**53 else float(f"{v:.9g}"))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(name: str, df, con, sql: str) -> str:
    """Empty if they agree, else what differs."""
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows(want_cols, cur.fetchall())
    got = rows(df.columns, df.collect())
    if sorted(df.columns) != sorted(want_cols):
        return f"{name}: columns {sorted(df.columns)} vs {sorted(want_cols)}"
    if got != want:
        g, w = set(got) - set(want), set(want) - set(got)
        return f"{name}: {len(got)} rows vs {len(want)}; only Spark {sorted(g, key=repr)[:3]}; only SQL {sorted(w, key=repr)[:3]}"
    return ""
