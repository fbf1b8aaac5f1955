"""Run registered queries beside their oracle SQL in DuckDB and compare.

usage: python check.py [-s SF_DIR] [name-or-module-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback

import duckdb

from tidemark.session import build_session, release_work
from workload import registry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
KINDS = {"tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT",
         "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "date": "DATE",
         "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}") + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([norm(r[i]) for i in order] for r in rows), key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def compare(df, rel):
    got_cols, want_cols = df.columns, rel.columns
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    want_types = dict(zip(rel.columns, map(str, rel.types)))
    bad = [(c, t, want_types[c]) for c, t in df.dtypes if KINDS.get(t, t) != want_types[c]]
    got, want = rows_of(got_cols, df.collect()), rows_of(want_cols, rel.fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"value {[(c, a, b) for c, a, b in zip(sorted(got_cols), g, w) if a != b][:4]}"
    if not got:
        return "EMPTY"
    return f"types {bad}" if bad else None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", default="/root/testdata/sf0.01")
    ap.add_argument("-m", help="only queries of this workload module")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    registry.load_all()
    spark = build_session("check", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{args.s}/{t}.parquet'")
    failed = 0
    for name, fn in registry.QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        if args.m and args.m not in registry.MODULE_OF[name]:
            continue
        start = time.time()
        try:
            df = fn(spark, args.s)
            sql = registry.ORACLES.get(name)
            why = compare(df, con.sql(sql)) if sql else f"no oracle, {df.count()} rows"
        except Exception as err:  # report and go on with the next query
            text = str(err) or traceback.format_exc()
            why = f"ERROR {type(err).__name__}: {text[:700]}"
        release_work(spark)
        bad = why and not why.startswith("no oracle")
        failed += bool(bad)
        if why:
            print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - start:.1f}s {why}", flush=True)
        elif args.names or time.time() - start > 3:
            print(f"ok   {name} {time.time() - start:.1f}s", flush=True)
    print(f"{failed} failed of {len(registry.QUERIES)} registered")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
