"""Run registered queries on Spark and their oracle SQL on DuckDB; compare like the driver.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return _norm(tuple(v))
    return repr(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    import duckdb
    from potentia.session import get_spark
    import __spark_entry__ as E

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(E.queries())
    spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    oracles = E.oracle_sql()
    ok_all = True
    for name in names:
        t0 = time.time()
        try:
            df = E.queries()[name](spark, sf)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:40s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            ok_all = False
            continue
        ts = time.time() - t0
        if name not in oracles:
            print(f"{name:40s} rows={len(rows)} (no oracle) {ts:.1f}s")
            continue
        t1 = time.time()
        try:
            cur = con.execute(oracles[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:40s} SQL-ERROR {str(e)[:300]}")
            ok_all = False
            continue
        to = time.time() - t1
        h1, l1 = digest(cols, rows)
        h2, l2 = digest(ocols, orows)
        same = sorted(cols) == sorted(ocols) and len(rows) == len(orows) and h1 == h2
        ok_all &= same
        print(f"{name:40s} {'OK ' if same else 'BAD'} rows={len(rows)}/{len(orows)} "
              f"spark={ts:.1f}s duck={to:.1f}s")
        if not same:
            if sorted(cols) != sorted(ocols):
                print("   cols", sorted(cols), sorted(ocols))
            diff = [(a, b) for a, b in zip(l1, l2) if a != b][:3]
            for a, b in diff:
                print("   spark:", a[:200])
                print("   duck :", b[:200])
    spark.stop()
    sys.exit(0 if ok_all else 1)


if __name__ == "__main__":
    main()
