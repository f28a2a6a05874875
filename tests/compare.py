"""Runs registered queries and their SQL twins and compares the rows.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def normal(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def difference(spark, con, sf_dir: str, run, sql: str) -> str | None:
    """None when the two results are equal, else what differs."""
    df = run(spark, sf_dir)
    mine = normal(df.columns, df.collect())
    result = con.execute(sql)
    theirs = normal([c[0] for c in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    if not mine[1]:
        return None
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b or list(map(type, a)) != list(map(type, b))]
    if bad:
        a, b = bad[0]
        cells = [(n, x, y) for n, x, y in zip(mine[0], a, b) if x != y or type(x) is not type(y)]
        return f"{len(bad)} of {len(mine[1])} rows differ, first: {cells}"
    return None


def main() -> None:
    from conftest import session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("OFF")
    oracle = entry.oracle_sql()
    for name, run in entry.queries().items():
        if args and name not in args:
            continue
        began = time.time()
        try:
            if name in oracle:
                found = difference(spark, con, sf_dir, run, oracle[name])
            else:
                found = f"no SQL, {run(spark, sf_dir).count()} rows"
        except Exception as error:
            found = f"ERROR {str(error)[:600]}"
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - began:.1f}s "
              f"{(found or '')[:900]}", flush=True)


if __name__ == "__main__":
    main()
