"""Run registered queries beside their SQL checks and compare all values.

    python tests/compare.py [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TEST_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{sf}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def _key(row):
    return tuple((v is None, str(type(v).__name__), v if v is not None else 0) if not isinstance(v, (list, dict)) else (False, "x", str(v)) for v in row)


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_plain(r[c]) for c in cols) for r in df.collect()]
    return cols, sorted(rows, key=_key)


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in cur.fetchall()]
    return [names[i] for i in order], sorted(rows, key=_key)


def difference(left, right) -> str | None:
    (lc, lr), (rc, rr) = left, right
    if lc != rc:
        return f"columns differ: {lc} / {rc}"
    if len(lr) != len(rr):
        return f"row counts differ: {len(lr)} / {len(rr)}"
    for a, b in zip(lr, rr):
        for n, x, y in zip(lc, a, b):
            if type(x) is not type(y) or (x != y and not (x != x and y != y)):
                return f"{n}: {x!r} / {y!r} in\n  {dict(zip(lc, a))}\n  {dict(zip(lc, b))}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    from reflexgrid.session import build

    args = sys.argv[1:]
    sf = "sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark, con = build("local[8]"), duck(sf)
    checks = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if args and not any(a in name for a in args):
            continue
        t0 = time.time()
        try:
            got = spark_rows(fn(spark, f"{DATA}/{sf}"))
            t1 = time.time()
            if name not in checks:
                print(f"rows {name}: {len(got[1])} rows {t1 - t0:.1f}s", flush=True)
                continue
            want = sql_rows(con, checks[name])
            diff = difference(got, want)
        except Exception as e:  # noqa: BLE001
            diff, t1, got = f"{type(e).__name__}: {str(e)[:1500]}", time.time(), ((), ())
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name}: {len(got[1])} rows, {t1 - t0:.1f}s + {time.time() - t1:.1f}s{'' if diff is None else ' ' + diff}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
