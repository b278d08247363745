"""Run every registered query beside its DuckDB twin and report differences.

usage: python tools/check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time

import duckdb

sys.path.insert(0, "/root/repo")
from mullion.session import session  # noqa: E402
from mullion import registry  # noqa: E402

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf = f"/root/testdata/sf{args.sf}"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")
    spark = session("check")
    qs, sql = registry.queries(), registry.oracle_sql()
    picked = [n for n in qs if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    bad = []
    for name in picked:
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            got = df.collect()
            t1 = time.time()
            if name not in sql:
                print(f"{name:6} rows-only {len(got)} {t1 - t0:.1f}s", flush=True)
                continue
            cur = con.execute(sql[name])
            wn = [d[0] for d in cur.description]
            want = cur.fetchall()
            t2 = time.time()
            if sorted(wn) != sorted(df.columns):
                raise ValueError(f"columns {sorted(df.columns)} != {sorted(wn)}")
            a, b = rows(df.columns, got), rows(wn, want)
            ok = a == b and (len(a) > 0)
            print(f"{name:6} {'ok' if ok else 'EMPTY' if a == b else 'DIFF'} {len(a)} vs {len(b)}  spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s", flush=True)
            if not ok:
                bad.append(name)
                sa, sb = set(map(repr, a)), set(map(repr, b))
                for x in sorted(sa - sb)[:3]:
                    print("   spark only:", x[:400])
                for x in sorted(sb - sa)[:3]:
                    print("   duck only: ", x[:400])
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"{name:6} ERROR {str(e)[:700]}", flush=True)
    print(f"{len(picked) - len(bad)} of {len(picked)} fine; not fine: {bad}")


if __name__ == "__main__":
    main()
