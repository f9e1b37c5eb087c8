"""Run registered queries and their SQL checks side by side.

    python tools/parity.py [--sf DIR] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from paperloom.plans import load_all  # noqa: E402
from paperloom.session import drop_cuts, local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads=4")
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "\0null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v if v != 0 else 0.0)
    return str(v)


def compare(spark_df, con, sql):
    cols = sorted(spark_df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in spark_df.collect()]
    compare.mid = time.time()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = dict(zip(names, [str(d[1]) for d in rel.description]))
    rows = rel.fetchall()
    if sorted(names) != cols:
        return f"columns differ: spark {cols} sql {sorted(names)}", len(got), len(rows)
    at = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in at) for r in rows]
    spark_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    off = [f"{c}:{t}/{types[c]}" for c, t in spark_types.items() if pairs.get(t, t) != types[c]]
    if sorted(got) == sorted(want):
        return ("ok" if not off else "ok, types differ " + " ".join(off)), len(got), len(rows)
    sg, sw = set(got), set(want)
    return f"rows differ {cols}\n   spark only {sorted(sg - sw)[:3]}\n   sql only {sorted(sw - sg)[:3]}", len(got), len(rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    queries, checks = load_all()
    spark = local_session(8)
    con = duck(args.sf)
    bad = 0
    for name, fn in queries.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, args.sf)
            if name in checks:
                res, n, m = compare(df, con, checks[name])
            else:
                n = m = df.count()
                res = "ok (rows only)"
            if not res.startswith("ok") or n == 0:
                bad += 1
        except Exception as e:  # noqa: BLE001 - report and go on
            res, n, m = f"ERROR {type(e).__name__}: {str(e)[:1500]}", -1, -1
            bad += 1
        mid = getattr(compare, "mid", None) or time.time()
        compare.mid = None
        print(f"{name:32s} {mid - t0:6.1f}s {time.time() - mid:6.1f}s  {n:>7d} {m:>7d}  {res}", flush=True)
    drop_cuts(spark)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
