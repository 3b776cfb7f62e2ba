"""Compare every registered query with its SQL twin: python tests/check_queries.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else "-0.0" if v == 0 and math.copysign(1, v) < 0 else v
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, name, fn, sql, sf):
    began = time.time()
    df = fn(spark, sf)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    if sql is None:
        return None, f"{len(got)} rows, no twin", took
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return False, f"columns {got_names} <> {want_names}", took
    if len(got) != len(want):
        return False, f"rows {len(got)} <> {len(want)}", took
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} differ, e.g. {bad[:2]}", took
    kinds = [(n, {type(r[i]).__name__ for r in got if r[i] is not None}, {type(r[i]).__name__ for r in want if r[i] is not None}) for i, n in enumerate(got_names)]
    odd = [k for k in kinds if k[1] != k[2]]
    return (not odd), f"{len(got)} rows" + (f" types {odd}" if odd else ""), took


def main():
    from __spark_entry__ import oracle_sql, queries

    from pairlens.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else f"/root/testdata/sf{args[0] if args else '0.01'}"
    wanted = args[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    oracles, failed = oracle_sql(), []
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note, took = compare(spark, name, fn, oracles.get(name), sf)
        except Exception as e:  # report and go on
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:700]}", 0
        print(f"{'ok  ' if ok else '--  ' if ok is None else 'FAIL'} {name} [{took:.1f}s] {note}", flush=True)
        if ok is False:
            failed.append(name)
    print("failed:", failed or "none")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
