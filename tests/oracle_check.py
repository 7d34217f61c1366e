"""Run Spark queries and their DuckDB oracles side by side; report row count, schema and value-hash matches.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quillspark.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    try:
        import numpy as np
        if isinstance(v, np.ndarray):
            return "[" + ",".join(_norm(x) for x in v.tolist()) + "]"
        if isinstance(v, np.generic):
            return _norm(v.item())
    except ImportError:
        pass
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_tuple"):  # Decimal
        return f"{float(v):.6g}"
    return str(v)


def frame_hash(df: pd.DataFrame) -> str:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df[cols].to_dict("records"))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()[:16]


def duck_conn(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    import __spark_entry__ as E
    from quillspark.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck_conn(sf_dir)
    bad = 0
    for k in keys or list(qs):
        t0 = time.time()
        try:
            sp = qs[k](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in os_:
            print(f"{k:32s} rows={len(sp)} (no oracle) {ts:.1f}s")
            continue
        try:
            du = con.execute(os_[k]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} DUCK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        same_cols = sorted(sp.columns) == sorted(du.columns)
        same_rows = len(sp) == len(du)
        same_hash = same_cols and frame_hash(sp) == frame_hash(du)
        ok = same_cols and same_rows and same_hash
        bad += not ok
        print(f"{k:32s} {'OK ' if ok else 'BAD'} rows={len(sp)}/{len(du)} cols={same_cols} hash={same_hash} {ts:.1f}s")
        if not same_cols:
            print("   spark:", sorted(sp.columns)); print("   duck: ", sorted(du.columns))
        elif not same_hash and same_rows:
            cols = sorted(sp.columns)
            a = sp[cols].astype(str).sort_values(cols).reset_index(drop=True)
            b = du[cols].astype(str).sort_values(cols).reset_index(drop=True)
            for c in cols:
                diff = [(x, y) for x, y in zip(a[c], b[c]) if _norm(x) != _norm(y)]
                if diff:
                    print(f"   col {c}: {len(diff)} diffs e.g. {diff[:3]}")
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
