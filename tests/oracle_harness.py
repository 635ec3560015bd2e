"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

Usage: python tests/oracle_harness.py [sf_dir] [key ...]

Comparison mirrors the driver's: row count, column names, and an
order-insensitive comparison of values with columns sorted by name.
Doubles are compared exactly and, separately, at 1e-9 relative tolerance.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v, approx: bool):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if approx:
            return float(f"{v:.9g}")
        return v
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item(), approx)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, approx) for x in v)
    return v


def rows_of(columns, records, approx: bool):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i], approx) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, key: str, sf_dir: str, con=None) -> dict:
    from prospect.plans import registry

    con = con or duck(sf_dir)
    t0 = time.time()
    df = registry.QUERIES[key](spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = {"key": key, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    sql = registry.ORACLES.get(key)
    if sql is None:
        res["status"] = "rows-only"
        return res
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    res["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = "COLUMNS"
        res["detail"] = f"spark-only={sorted(set(s_cols) - set(d_cols))} oracle-only={sorted(set(d_cols) - set(s_cols))}"
        return res
    if len(s_rows) != len(d_rows):
        res["status"] = "ROWCOUNT"
        return res
    exact = rows_of(s_cols, s_rows, False) == rows_of(d_cols, d_rows, False)
    if exact:
        res["status"] = "match"
        return res
    a, b = rows_of(s_cols, s_rows, True), rows_of(d_cols, d_rows, True)
    if a == b:
        res["status"] = "match~"
        return res
    res["status"] = "VALUES"
    cols = sorted(s_cols)
    for x, y in zip(a, b):
        if x != y:
            diffs = [(cols[i], x[i], y[i]) for i in range(len(cols)) if x[i] != y[i]]
            res["detail"] = str(diffs[:4])
            break
    return res


def main(argv):
    from prospect.plans import registry
    from prospect.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:] or list(registry.QUERIES)
    spark = local_session(8)
    con = duck(sf_dir)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, k, sf_dir, con)
        except Exception as exc:  # report and continue
            r = {"key": k, "status": "ERROR", "detail": repr(exc)[:400]}
        if r["status"] not in ("match", "match~", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"done: {len(keys)} keys, {bad} not matching", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
