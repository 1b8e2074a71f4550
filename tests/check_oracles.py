"""Run queries beside their SQL twins and compare rows: ``check_oracles.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vulntide.catalog import ORACLES, QUERIES  # noqa: E402
from vulntide.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(value)


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(record[i]) for i in order) for record in records)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    ours = [tuple(row) for row in df.collect()]
    mid = time.time()
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    theirs = cursor.fetchall()
    took = f"{len(ours)} rows, spark {mid - start:.1f}s, duckdb {time.time() - mid:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"{took}; columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = _rows(df.columns, ours), _rows(names, theirs)
    if a == b:
        return True, took
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return False, (
        f"{took}; duckdb has {len(b)} rows; columns {sorted(names)}\n"
        f"   only spark {len(only_a)}: {str(only_a[:2])[:900]}\n"
        f"   only duckdb {len(only_b)}: {str(only_b[:2])[:900]}"
    )


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark, con = local_session(8, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="vulntide-check-")}), connect(sf_dir)
    bad = 0
    for name in args or sorted(QUERIES):
        try:
            ok, note = compare(spark, con, sf_dir, name) if name in ORACLES else (True, "no twin")
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:1200]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
