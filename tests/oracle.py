"""Compare registered queries with their SQL twins in DuckDB.

``python tests/oracle.py SF_DIR [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, datetime.datetime):
        return v.date().isoformat()
    return str(v)


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, run, sql: str | None) -> tuple[bool, str]:
    df = run(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    if sql is None:
        return True, f"rows={len(got)} (no SQL)"
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    want = _rows(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if got != want:
        a, b = set(got), set(want)
        return False, f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    return True, f"rows={len(got)}"


if __name__ == "__main__":
    from tallyweave.queries import ORACLES, QUERIES
    from tallyweave.session import build_session

    sf = sys.argv[1]
    spark = build_session(master="local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    names = sys.argv[2:] or list(QUERIES)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            ok, note = compare(spark, con, sf, QUERIES[n], ORACLES.get(n))
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {n} {note} {time.time() - t0:.1f}s", flush=True)
    print("bad:", bad)
