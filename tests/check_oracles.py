"""Run registered queries against their SQL on the same tables: python tests/check_oracles.py [sf_dir] [name prefix ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and pd.isna(v)):
            return "~"
        if isinstance(v, float):
            return f"{v + 0.0:.9g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
        return str(v)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf: str, name: str, run, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = run(spark, sf)
    got = [tuple(x) for x in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"rows-only {len(got)} rows {took:.1f}s"
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = canonical(got, df.columns), canonical(want, cols)
    if a == b:
        return len(a) > 0, f"{len(a)} rows {took:.1f}s" + ("" if a else " EMPTY")
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return False, f"rows {len(a)} vs {len(b)}\n   columns {sorted(cols)}\n   spark {only_a}\n   sql   {only_b}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    import __spark_entry__ as entry
    from tickloom.session import local_session

    spark = local_session(8)
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, run in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, text = compare(spark, con, sf, name, run, oracles.get(name))
        except Exception as exc:
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        if not ok:
            bad.append(name)
        print(("ok  " if ok else "FAIL"), name, text, flush=True)
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
