"""Run registered queries on Spark beside their SQL on DuckDB and report differences.

usage: python tools/compare.py [sf or folder] [name-prefix ...]
"""

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from checks import ORACLES, QUERIES  # noqa: E402
from tramline.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if v is None or isinstance(v, (bool, int, str)):
        return v
    return str(v)


def key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def compare(name, got_cols, got, con):
    rel = con.sql(ORACLES[name])
    cols = rel.columns
    want = rel.fetchall()
    if sorted(cols) != sorted(got_cols):
        return f"columns {sorted(got_cols)} != {sorted(cols)}"
    order = sorted(cols)
    a = sorted((tuple(norm(r[got_cols.index(c)]) for c in order) for r in got), key=key)
    b = sorted((tuple(norm(r[cols.index(c)]) for c in order) for r in want), key=key)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        sa, sb = set(map(str, a)), set(map(str, b))
        return f"{len(bad)} rows differ in {order}; spark-only {sorted(sa - sb)[:3]} sql-only {sorted(sb - sa)[:3]}"
    types = {c: {type(x[i]).__name__ for x in a} | {type(y[i]).__name__ for y in b} for i, c in enumerate(order)}
    mixed = {c: t for c, t in types.items() if len(t - {"NoneType"}) > 1}
    return f"types {mixed}" if mixed else None


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    d = sf if "/" in sf else f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    good = bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, d)
            rows = [tuple(x) for x in df.collect()]
            took = time.time() - t0
            problem = compare(name, df.columns, rows, con) if name in ORACLES else None
            if name not in ORACLES:
                state = "rows-only" if rows else "EMPTY"
            else:
                state = problem or ("ok" if rows else "ok but EMPTY")
        except Exception as e:  # report and go on with the next query
            took, problem = time.time() - t0, "error"
            state = "ERROR " + (str(e).strip() or traceback.format_exc())[:600]
            rows = []
        good, bad = good + (problem is None), bad + (problem is not None)
        print(f"{name:36s} {took:6.2f}s {len(rows):7d}  {state}", flush=True)
    print(f"good {good} bad {bad}")


if __name__ == "__main__":
    main()
