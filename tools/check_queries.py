"""Run registered queries next to their SQL twins: ``check_queries.py [prefix ...] [--sf 0.01]``."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardlight.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, pd.Timestamp):
        return str(v)
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    data = [tuple(plain(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(data, key=lambda r: tuple((x is None, str(type(x)) if x is None else "", str(x)) for x in r))


def close(a, b) -> bool:
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("prefixes", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--explain", action="store_true")
    args = ap.parse_args()
    from wardlight.plans.catalog import QUERIES

    d = f"/root/testdata/sf{args.sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    spark = local_session(8)
    bad = []
    for name, q in QUERIES.items():
        if args.prefixes and not any(name == p or name.startswith(p) for p in args.prefixes):
            continue
        try:
            t0 = time.time()
            df = q.run(spark, d)
            if args.explain:
                df.explain("formatted")
            got = df.toPandas()
            t1 = time.time()
            if q.sql is None:
                print(f"{'rows' if len(got) else 'EMPTY':8} {name:36} {len(got):8d} rows {t1 - t0:6.2f}s", flush=True)
                if not len(got):
                    bad.append(name)
                continue
            want = con.execute(q.sql).df()
            t2 = time.time()
            note = ""
            if sorted(got.columns) != sorted(want.columns):
                note = f"columns {sorted(set(got.columns) ^ set(want.columns))}"
            else:
                a, b = rows_of(got), rows_of(want)
                if len(a) != len(b):
                    note = f"rows {len(a)} vs {len(b)}"
                elif a != b:
                    diff = [(x, y) for x, y in zip(a, b) if x != y]
                    far = [p for p in diff if not all(close(u, v) for u, v in zip(*p))]
                    note = f"{len(diff)} differ, {len(far)} beyond tolerance: {sorted(got.columns)} {(far or diff)[:2]}"[:1500]
                elif not a:
                    note = "no rows"
            print(f"{'BAD' if note else 'ok':8} {name:36} {len(got):8d} rows {t1 - t0:6.2f}s sql {t2 - t1:6.2f}s {note}", flush=True)
            if note:
                bad.append(name)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            text = str(e)
            print(f"ERROR    {name}: {type(e).__name__} {text[:1200]}", flush=True)
            if not text:
                traceback.print_exc()
    print("BAD:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
