"""Run registered queries next to their SQL: python tests/oracle.py [--sf DIR] [name ...]"""

from __future__ import annotations

import os
import signal
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    return v


def canonical(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is not None, str(x)) for x in t))


def compare(spark, con, name: str, path: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    from wxspark.catalog import ORACLES, QUERIES

    df = QUERIES[name](spark, path)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return None
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = canonical(df.columns, got), canonical(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        cols = sorted(names)
        x, y = bad[0]
        diff = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q]
        return f"{len(bad)} of {len(a)} rows differ, first: {diff[:4]} in {x[:6]}"
    if {type(v) for r in a for v in r} - {type(None)} != {type(v) for r in b for v in r} - {type(None)}:
        return f"types {({type(v).__name__ for r in a for v in r})} != {({type(v).__name__ for r in b for v in r})}"
    return None


def main(argv: list[str]) -> int:
    from wxspark.catalog import ORACLES, QUERIES
    from wxspark.session import build

    path = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        path, argv = argv[1], argv[2:]
    names = argv or list(QUERIES)
    spark = build("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    failed = 0

    def late(*_):
        raise TimeoutError("over 60 s")

    signal.signal(signal.SIGALRM, late)
    for n in names:
        t0 = time.time()
        signal.alarm(60)
        try:
            why = compare(spark, con, n, path)
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:600]}"
        signal.alarm(0)
        failed += why is not None
        print(f"{'ok ' if why is None else 'BAD'} {n} {time.time() - t0:.2f}s {'' if n in ORACLES else '(rows only)'} {why or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
