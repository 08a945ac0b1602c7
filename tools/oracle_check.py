"""Run registered queries in Spark and their oracle SQL in DuckDB; compare results.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Prints one line per query: name, status, row counts, seconds.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm_value(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return norm_value(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm_value(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm_value(x)) for k, x in v.items()))
    from decimal import Decimal
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return int(v)
    return v


def norm_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    scols = df.columns
    srows = [tuple(r) for r in df.collect()]
    ts = time.time() - t0
    if sql is None:
        return name, "rows-only", len(srows), None, ts
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(scols) != sorted(dcols):
        return name, f"COLUMNS spark={scols} duck={dcols}", len(srows), len(drows), ts
    a, b = norm_rows(scols, srows), norm_rows(dcols, drows)
    if len(a) != len(b):
        return name, "ROWCOUNT", len(a), len(b), ts
    if a != b:
        bad = next(i for i in range(len(a)) if a[i] != b[i])
        return name, f"VALUES first diff spark={a[bad]!r:.300} duck={b[bad]!r:.300}", len(a), len(b), ts
    return name, "ok", len(a), len(b), ts


def main():
    from quire import get_spark
    from quire.plans import ORACLE, QUERIES
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, QUERIES[n], ORACLE.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = (n, f"ERROR {type(e).__name__}: {str(e)[:400]}", None, None, 0)
        if r[1] not in ("ok", "rows-only"):
            bad += 1
        print(f"{r[0]:40s} {r[1]:10s} spark={r[2]} duck={r[3]} {r[4]:.2f}s", flush=True)
    print(f"mismatches: {bad}")


if __name__ == "__main__":
    main()
