"""Run registered queries beside their SQL twins and compare all values.

    python check_queries.py [--dir /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from lexweave.plans.all import QUERIES, SQL
from lexweave.session import local_session


def _plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__module__ == "numpy":
        number = float(value)
        return round(number, 6)
    return str(value)


def rows_of(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    found = [tuple(_plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)]
    return sorted(found, key=repr)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def check(spark, con, sf_dir: str, name: str) -> str | None:
    """None if all is well, else what differs."""
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        return None if len(got) else "no rows"
    want = con.execute(SQL[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} are not {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if a == b:
        return None
    first = next((p for p in zip(a, b) if p[0] != p[1]), ())
    return f"{len(a)} rows against {len(b)}; first difference {str(first)[:600]}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = local_session(8), connect(args.dir)
    wrong = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            problem = check(spark, con, args.dir, name)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        kind = "sql" if name in SQL else "rows"
        print(f"{name:28} {kind:4} {time.time() - start:6.1f}s  {problem or 'ok'}", flush=True)
        wrong += problem is not None
    print(f"{wrong} wrong")
    return wrong


if __name__ == "__main__":
    sys.exit(main())
