"""Compare registered queries with their SQL: python check_oracle.py SF_DIR [query ...]"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

from issueforge.oracle import ORACLE
from issueforge.registry import QUERIES
from issueforge.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def canonical(value: object) -> object:
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else repr(value)
    return "NULL" if value is None else str(value)


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def compare(spark, con, sf_dir: str, name: str) -> str:
    started = time.time()
    frame = QUERIES[name](spark, sf_dir)
    got = frame.collect()
    took = time.time() - started
    if name not in ORACLE:
        return f"rows-only {name:28s} {len(got)} rows {took:.1f}s"
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"COLUMNS   {name}: {sorted(frame.columns)} != {sorted(columns)}"
    left, right = rows_of(frame.columns, got), rows_of(columns, want)
    if left != right:
        only = [r for r in left if r not in set(right)][:2], [r for r in right if r not in set(left)][:2]
        return f"DIFFERENT {name}: {len(left)} vs {len(right)} rows; spark only {only[0]}; sql only {only[1]}"
    return f"ok        {name:28s} {len(got)} rows {took:.1f}s"


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "8", **{"spark.ui.showConsoleProgress": "false"})
    con = connect(sf_dir)
    for name in names:
        try:
            print(compare(spark, con, sf_dir, name), flush=True)
        except Exception as error:  # report and go on with the other queries
            print(f"FAILED    {name}: {str(error)[:600]!r}", flush=True)


if __name__ == "__main__":
    main()
