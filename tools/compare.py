"""Run registered queries next to their DuckDB twins and compare values.

    python tools/compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyglass.session import build_session  # noqa: E402
from tallyglass.workload import QUERIES, TWINS  # noqa: E402
from tallyglass.workload.roles import TABLES  # noqa: E402


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if isinstance(v, (int, str)) else str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, sf_dir):
    """(ok, message, seconds)"""
    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if name not in TWINS:
        return True, f"rows only: {len(rows)}", took
    cur = con.execute(TWINS[name])
    want_cols, want = canon([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = canon(df.columns, rows)
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", took
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; first got {got[:2]} want {want[:2]}", took
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, e.g. got {bad[0][0]} want {bad[0][1]}", took
    kinds = {c: (type(next((r[i] for r in got if r[i] is not None), None)), type(next((r[i] for r in want if r[i] is not None), None))) for i, c in enumerate(got_cols)}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if odd:
        return False, f"types differ {odd}", took
    return True, f"{len(got)} rows", took


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = build_session(cpus=8), duck(sf_dir)
    names = [n for n in QUERIES if not args or any(n.startswith(a) for a in args)]
    failed = 0
    for n in names:
        try:
            ok, msg, took = compare(spark, con, n, sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, msg, took = False, f"{type(exc).__name__}: {str(exc)[:700]}", 0.0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n:34s} {took:6.2f}s {msg}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")


if __name__ == "__main__":
    main()
