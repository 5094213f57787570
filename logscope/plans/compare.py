"""Order-insensitive comparison of a Spark result with an oracle result."""

from __future__ import annotations

import datetime as dt
import math
import os

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_views(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canonical(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark_df, con, sql: str) -> list[str]:
    """Reasons the two results differ (empty when they match)."""
    scols = spark_df.columns
    srows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    why = []
    if sorted(scols) != sorted(ocols):
        why.append(f"columns spark={sorted(scols)} oracle={sorted(ocols)}")
    if len(srows) != len(orows):
        why.append(f"rows spark={len(srows)} oracle={len(orows)}")
    if not why:
        a, b = canonical(scols, srows), canonical(ocols, orows)
        if a != b:
            why.append(f"values differ, e.g. {[(x, y) for x, y in zip(a, b) if x != y][:3]}")
    return why
