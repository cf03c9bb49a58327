"""Run registered queries next to their oracle SQL: ``python tests/compare.py SF [name-prefix ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def near(x, y):
    """Equal up to one unit of the last decimal that either shows (engines round exact ties differently)."""
    if isinstance(x, float) and isinstance(y, float):
        shown = max(-Decimal(repr(v)).as_tuple().exponent for v in (x, y))
        return math.isclose(x, y, rel_tol=1e-9, abs_tol=1.1 * 10.0 ** -max(shown, 5) if shown < 12 else 1e-11)
    return x == y


def compare(spark, con, sf_dir, name, fn, sql, exact=True):
    """Returns (ok, message)."""
    t = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    spent = time.time() - t
    if sql is None:
        return bool(got), f"{len(got)} rows, {spent:.1f}s, no oracle"
    rel = con.sql(sql)
    want_cols, want = rel.columns, rel.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    a, b = rows(got_cols, got), rows(want_cols, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad and not exact:
        bad = [(x, y) for x, y in bad if not all(map(near, x, y))]
    if bad:
        cols = sorted(got_cols)
        x, y = bad[0]
        diff = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q][:6]
        return False, f"{len(bad)} of {len(a)} rows differ, e.g. {diff} in {x[:8]}"
    return True, f"{len(got)} rows, {spent:.1f}s"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries as all_queries
    from barspan.session import local_session

    sf, prefixes = sys.argv[1], tuple(sys.argv[2:]) or ("",)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = all_queries(), oracle_sql()
    failed = []
    for name, fn in queries.items():
        if not name.startswith(prefixes):
            continue
        try:
            ok, msg = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:500]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {msg}", flush=True)
    print(f"failed: {failed}")
