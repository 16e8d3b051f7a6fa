"""Run queries against their DuckDB equivalents: ``check_oracle.py [sf_dir] [key ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from relaylens.plans import catalogue, views  # noqa: E402
from relaylens.session import build_session  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in views.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bool) or value is None:
        return value
    return float(value) if isinstance(value, int) and abs(value) < 2**53 else str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([cell(row[i]) for i in order] for row in rows), key=repr)


def compare(spark, con, key, sf_dir):
    """None when both sides agree, else a short description of the difference."""
    got = catalogue.queries()[key](spark, sf_dir)
    left = canonical(got.columns, [tuple(r) for r in got.collect()])
    sql = catalogue.oracle_sql().get(key)
    if sql is None:
        return None if left else "no rows and no oracle"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    right = canonical(names, result.fetchall())
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} != {sorted(names)}"
    if left != right:
        odd_l = [r for r in left if r not in right][:2]
        odd_r = [r for r in right if r not in left][:2]
        return f"{len(left)} vs {len(right)} rows; spark {odd_l}; duckdb {odd_r}"
    return None if left else "both sides are empty"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:] or list(catalogue.queries())
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for key in keys:
        start = time.time()
        try:
            problem = compare(spark, con, key, sf_dir)
        except Exception as error:  # keep going, report at the end
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        oracle = "" if key in catalogue.oracle_sql() else " (no oracle)"
        print(f"{'FAIL' if problem else 'ok  '} {key}{oracle} {time.time() - start:.1f}s "
              f"{problem or ''}", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv) > 0)
