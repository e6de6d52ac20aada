"""Runs queries next to their SQL and compares the rows."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def differences(spark, name: str, sf_dir: str, con) -> list[str]:
    import __spark_entry__ as contract

    df = contract.queries()[name](spark, sf_dir)
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in contract.oracle_sql():
        return [] if actual else ["no rows"]
    result = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = _rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    found = []
    if len(actual) != len(expected):
        found.append(f"{len(actual)} rows, expected {len(expected)}")
    found += [f"{a} != {e}" for a, e in zip(actual, expected) if repr(a) != repr(e)][:3]
    return found


if __name__ == "__main__":
    from conftest import make_session

    spark = make_session()
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as contract

    wanted = sys.argv[2:] or list(contract.queries())
    con = connect(sf)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problems = differences(spark, name, sf, con)
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", *problems, sep="\n   " if problems else " ")
    print("failed:", bad, "of", len(wanted))
