"""Run registered queries on Spark and their SQL on DuckDB, and compare.

usage: python tools/compare.py [sf_dir] [name or prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if hasattr(value, "item"):
        return normal(value.item())
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return str(value)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        [tuple(normal(row[i]) for i in order) for row in data], key=str)


def same(spark, con, fn, sql, sf_dir) -> str:
    """'' when equal, else what differs."""
    df = fn(spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    if sql is None:
        return "" if got else "no rows"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = dict(zip(names, [str(d[1]) for d in rel.description]))
    want_names, want = rows_of(names, rel.fetchall())
    if got_names != want_names:
        return f"columns {got_names} vs {want_names}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
    odd = {c: (t, types[c]) for c, t in df.dtypes if kinds.get(t, types[c]) != types[c]}
    if odd:
        return f"types {odd}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        cells = [(n, a, b) for n, a, b in zip(got_names, *bad[0]) if a != b]
        return f"{len(bad)} of {len(got)} rows differ, first {cells[:6]}"
    return "" if got else "both empty"


def main(argv):
    from driftline.plans.catalog import ORACLES, QUERIES
    from driftline.session import local_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(sf_dir)
    failed, total = [], time.time()
    for name, fn in QUERIES.items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            problem = same(spark, con, fn, ORACLES.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        mark = "ok" if not problem else "FAIL"
        kind = "" if name in ORACLES else " (rows only)"
        print(f"{mark:5} {time.time() - start:6.2f}s {name}{kind} {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"failed {len(failed)}: {failed}; {time.time() - total:.0f}s")
    return 1 if failed else 0


if __name__ == "__main__":
    code = main(sys.argv[1:])
    sys.stdout.flush()
    os._exit(code)
