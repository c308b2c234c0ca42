"""Run registered queries next to their check SQL and compare whole results.

    python tools/check_oracle.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tidemark.plans import load_all  # noqa: E402
from tidemark.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return str(v)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple(("" if x is None else f"{type(x).__name__}{x!r}") for x in r))


def compare(spark, con, q, sf_dir):
    t0 = time.time()
    df = q.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if q.sql is None:
        return "rows-only", len(got), t1 - t0, 0.0, ""
    cur = con.execute(q.sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(cols) != sorted(df.columns):
        return "SCHEMA", len(got), t1 - t0, t2 - t1, f"{sorted(df.columns)} vs {sorted(cols)}"
    a, b = normalise(df.columns, got), normalise(cols, want)
    if a == b:
        return "ok", len(got), t1 - t0, t2 - t1, ""
    sa, sb = set(a), set(b)
    detail = f"rows {len(a)} vs {len(b)}; cols {sorted(cols)}\n   only spark {sorted(map(str, sa - sb))[:3]}\n   only sql   {sorted(map(str, sb - sa))[:3]}"
    return "DIFF", len(got), t1 - t0, t2 - t1, detail


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    wanted = args[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    registry = load_all()
    bad = 0
    for name, q in registry.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, n, ts, td, detail = compare(spark, con, q, sf_dir)
        except Exception as e:  # noqa: BLE001 - a report, not a handler
            status, n, ts, td, detail = "ERROR", -1, 0.0, 0.0, str(e)[:1500]
        if status not in ("ok", "rows-only"):
            bad += 1
        zero = "  EMPTY" if n == 0 else ""
        print(f"{status:9s} {name:40s} rows={n:7d} spark={ts:6.2f}s duckdb={td:6.2f}s{zero} {detail}", flush=True)
    print("failures:", bad)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
