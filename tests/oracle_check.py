"""Run registered queries in Spark and their DuckDB oracle SQL side by
side; compare row count, column names and an order-insensitive value
digest.  Usage: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, con, name, fn, sql, sf_dir, verbose=True):
    t = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    ts = time.time() - t
    if sql is None:
        return {"name": name, "ok": None, "rows": len(srows), "spark_s": ts}
    t = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    td = time.time() - t
    ok_cols = sorted(scols) == sorted(dcols)
    hs, ls = digest(scols, srows)
    hd, ld = digest(dcols, drows)
    ok = ok_cols and len(srows) == len(drows) and hs == hd
    out = {"name": name, "ok": ok, "rows": len(srows), "oracle_rows": len(drows),
           "cols_ok": ok_cols, "spark_s": round(ts, 2), "duck_s": round(td, 2)}
    if not ok and verbose:
        print("  spark cols", sorted(scols), "\n  duck  cols", sorted(dcols))
        a, b = set(ls), set(ld)
        print("  only spark:", list(a - b)[:3])
        print("  only duck :", list(b - a)[:3])
    return out


def main():
    from tessera.session import local_session
    from tessera.plans.catalog import CATALOG
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(CATALOG)
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        fn, sqlf = CATALOG[n]
        try:
            r = compare(spark, con, n, fn, sqlf() if sqlf else None, sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": n, "ok": False, "error": repr(e)[:400]}
        bad += r.get("ok") is False
        print(r, flush=True)
    print("FAILED", bad, "of", len(names))


if __name__ == "__main__":
    main()
