"""Run registered queries in Spark and their SQL oracles in DuckDB; compare.

Usage: ``python tests/oracle.py [sf_dir] [name ...]``.  Also imported by
``tests/test_oracle.py``.  The comparison mirrors the driver's gate: same
column names, same row count, and equal rows as an unordered multiset, with
floating point values compared after rounding to 6 decimals.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    return cols, sorted(rows, key=_key)


def duck_rows(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    data = rel.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    rows = [tuple(_norm(r[i]) for i in order) for r in data]
    return cols, sorted(rows, key=_key)


def compare(spark, sf_dir: str, names=None, verbose=True):
    import __spark_entry__ as entry

    qs = entry.queries()
    sqls = entry.oracle_sql()
    con = duck_connection(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            s_cols, s_rows = spark_rows(qs[name](spark, sf_dir))
        except Exception as e:  # noqa: BLE001
            results[name] = f"spark error: {type(e).__name__}: {str(e)[:300]}"
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = f"rows-only ({len(s_rows)} rows)"
            continue
        try:
            d_cols, d_rows = duck_rows(con, sqls[name])
        except Exception as e:  # noqa: BLE001
            results[name] = f"duckdb error: {type(e).__name__}: {str(e)[:300]}"
            continue
        if s_cols != d_cols:
            results[name] = f"column mismatch: spark={s_cols} duck={d_cols}"
        elif len(s_rows) != len(d_rows):
            results[name] = f"row count mismatch: spark={len(s_rows)} duck={len(d_rows)}"
        elif s_rows != d_rows:
            diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:3]
            results[name] = f"value mismatch ({len(s_rows)} rows): {diff}"
        else:
            results[name] = "ok"
        if verbose:
            print(f"{name:40s} {ts:6.2f}s {results[name]}", flush=True)
    return results


if __name__ == "__main__":
    from tablelens.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if v != "ok" and not v.startswith("rows-only")}
    print(f"\n{len(res) - len(bad)}/{len(res)} ok or rows-only")
    for k, v in bad.items():
        print("FAIL", k, v)
