"""Compare registered queries with their DuckDB oracles; run as a script for chosen names.

    python tests/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _shape(table: pa.Table) -> tuple[list, list]:
    names = sorted(table.column_names)
    types = []
    for n in names:
        t = table.schema.field(n).type
        types.append("string" if pa.types.is_large_string(t) or pa.types.is_string(t) else str(t))
    columns = [table.column(n).to_pylist() for n in names]
    rows = sorted(zip(*columns), key=lambda row: [(v is not None, repr(type(v)), repr(v)) for v in row])
    return list(zip(names, types)), rows


def differences(spark_table: pa.Table, oracle_table: pa.Table) -> list[str]:
    """Empty if both hold the same columns, types and rows in any order; values must be equal."""
    left_schema, left = _shape(spark_table)
    right_schema, right = _shape(oracle_table)
    if left_schema != right_schema:
        return [f"schema: spark only {set(left_schema) - set(right_schema)}, "
                f"oracle only {set(right_schema) - set(left_schema)}"]
    if len(left) != len(right):
        return [f"rows: spark {len(left)}, oracle {len(right)}"]
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return [f"{len(bad)} of {len(left)} rows differ, e.g.\n   {a}\n   {b}" for a, b in bad[:1]]


def main() -> int:
    from catalog import ORACLES, QUERIES
    from hazardframe.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    names = [n for n in QUERIES if not args.names or any(n.startswith(a) for a in args.names)]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    failed = 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, args.sf).toArrow()
            took = time.time() - start
            if name in ORACLES:
                want = con.execute(ORACLES[name]).to_arrow_table()
                problems = differences(got, want)
            else:
                problems = [] if got.num_rows else ["no rows"]
        except Exception as e:  # report and go on with the next query
            took, got, problems = time.time() - start, None, [f"{type(e).__name__}: {str(e)[:400]}"]
        status = "FAIL" if problems else ("ok" if name in ORACLES else "rows")
        failed += bool(problems)
        print(f"{status:5} {name:32} {took:6.2f}s {got.num_rows if got is not None else '-'}", *problems, flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
