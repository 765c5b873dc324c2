"""Run registered queries beside their SQL on DuckDB and report differences.

``python tests/compare.py [sf] [name or prefix ...]``
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry
from lakewarden.plans import derived
from lakewarden.session import build_session


def connect(sf: str):
    con = duckdb.connect()
    for name in derived.BASE:
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    """One form for values both engines spell differently."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if hasattr(value, "isoformat"):
        return str(value)[:26]
    if isinstance(value, (int, float)) or type(value).__module__ == "numpy":
        number = float(value)
        return int(number) if number == int(number) and abs(number) < 1e15 else round(number, 9)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def compare(spark, con, sf, name):
    """``(spark rows, problem)``; the problem is empty when both agree."""
    df = entry.queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    wide = [d[0] for d in cur.description if str(d[1]) in ("HUGEINT", "UHUGEINT")]
    if wide:
        return len(got), f"columns wider than any Spark integer: {wide}"
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return len(got), f"{len(a)} against {len(b)} rows; spark only {only_a}; sql only {only_b}"
    return len(got), ""


def main() -> int:
    args = sys.argv[1:]
    sf = f"/root/testdata/sf{args[0] if args else '0.01'}"
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    names = [n for n in entry.queries() if not args[1:] or any(n.startswith(a) for a in args[1:])]
    for name in names:
        begin = time.time()
        try:
            n, problem = compare(spark, con, sf, name)
        except Exception as wrong:  # report and go on to the next query
            n, problem = -1, f"{type(wrong).__name__}: {str(wrong)[:700]}"
        bad += bool(problem)
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name} {n} rows {time.time() - begin:.1f}s {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
