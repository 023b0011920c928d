"""Run registered queries against their SQL checks: ``python tests/harness.py [sf] [name ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute("SET memory_limit='10GB'")
    con.execute("SET max_temp_directory_size='4GB'")
    con.execute("SET temp_directory='/tmp/folio-duck'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return round(f, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def kind(v):
    return "null" if v is None else type(v).__name__


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf):
    t0 = time.time()
    df = fn(spark, sf)
    got_cols, got = table(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got)}", t1 - t0, 0.0
    cur = con.execute(sql)
    want_cols, want = table([c[0] for c in cur.description], cur.fetchall())
    t2 = time.time()
    if got_cols != want_cols:
        return f"COLUMNS {got_cols} != {want_cols}", t1 - t0, t2 - t1
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"DIFF rows {len(got)} vs {len(want)}; cols {got_cols}; " + "; ".join(f"spark {a} sql {b}" for a, b in bad), t1 - t0, t2 - t1
    kinds = {c: ({kind(r[i]) for r in got[:200]} | {kind(r[i]) for r in want[:200]}) - {"null"} for i, c in enumerate(got_cols)}
    odd = {c: k for c, k in kinds.items() if len(k) > 1}
    note = "" if got else " EMPTY"
    return f"ok {len(got)}{note}" + (f" types {odd}" if odd else ""), t1 - t0, t2 - t1


def main(argv):
    from folio import checks
    from folio.session import local_session
    sf = argv[0] if argv else "/root/testdata/sf0.001"
    if not sf.startswith("/"):
        sf = f"/root/testdata/{sf}"
    queries, oracles = checks.load()
    pick = [n for n in queries if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    spark = local_session(8)
    con = duck(sf)
    failed = []
    for n in pick:
        try:
            res, a, b = compare(spark, con, n, queries[n], oracles.get(n), sf)
        except Exception as e:  # report and go on
            res, a, b = f"ERROR {type(e).__name__}: {str(e)[:600]}", 0, 0
        if not res.startswith(("ok", "rows-only")) or "EMPTY" in res:
            failed.append(n)
        print(f"{n:34s} {a:6.2f}s {b:6.2f}s  {res[:900]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
