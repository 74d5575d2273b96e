"""Run registered queries against DuckDB: python tests/compare_oracle.py [sf] [name prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def check(spark, con, sf, name, query, oracle):
    t = time.time()
    df = query(spark, sf)
    got_c, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    if oracle is None:
        return f"rows-only {len(got)}", spent
    cur = con.execute(oracle)
    want_c, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_c != want_c:
        return f"COLUMNS {set(got_c) ^ set(want_c)}", spent
    if got != want:
        extra, lack = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return f"DIFF {len(got)} vs {len(want)} got {extra} want {lack} {got_c}", spent
    return ("ok" if got else "ok EMPTY") + f" {len(got)}", spent


def main():
    from trialloom.session import build_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, con = build_session(), connect(sf)
    bad = 0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            result, spent = check(spark, con, sf, name, fn, entry.oracle_sql().get(name))
        except Exception as e:  # report and go on
            result, spent = "ERROR " + str(e)[:700], 0
        bad += not result.startswith(("ok", "rows-only"))
        print(f"{name:40s} {spent:6.2f}s {result}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
