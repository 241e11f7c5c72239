"""Run every registered query in Spark and its oracle SQL in DuckDB and
compare row counts, column names and an order-insensitive value hash.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, dict):
        return {k: norm(x) for k, x in sorted(v.items())}
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr([norm(r[i]) for i in order]) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from tidemark.session import local_session
    spark = local_session()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    ok_all = True
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:22s} SPARK-ERROR {type(e).__name__}: {str(e)[:400]}")
            ok_all = False
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"{name:22s} rows-only  spark_rows={len(s_rows)} {t1 - t0:.1f}s")
            continue
        try:
            cur = con.execute(sqls[name])
            d_cols = [c[0] for c in cur.description]
            d_rows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:22s} DUCK-ERROR {type(e).__name__}: {str(e)[:600]}")
            ok_all = False
            continue
        hs, ls = digest(s_cols, s_rows)
        hd, ld = digest(d_cols, d_rows)
        same = sorted(s_cols) == sorted(d_cols) and len(s_rows) == len(d_rows) and hs == hd
        ok_all &= same
        print(f"{name:22s} {'OK ' if same else 'BAD'} rows spark={len(s_rows)} duck={len(d_rows)} {t1 - t0:.1f}s")
        if not same:
            if sorted(s_cols) != sorted(d_cols):
                print("   cols spark", sorted(s_cols), "\n   cols duck ", sorted(d_cols))
            a, b = set(ls), set(ld)
            for x in sorted(a - b)[:3]:
                print("   spark-only", x[:700])
            for x in sorted(b - a)[:3]:
                print("   duck-only ", x[:700])
    print("ALL OK" if ok_all else "MISMATCHES")
    return 0 if ok_all else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
