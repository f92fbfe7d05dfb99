"""Run registered queries and their SQL side by side: ``python -m checks.compare [folder] [name...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.expected import SQL
from checks.queries import QUERIES
from lodgewise.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return df.sort_values(list(df.columns), key=lambda s: s.map(repr)).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if both hold the same rows and columns."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        kinds = {type(x).__name__ for x in a[c] if x is not None}, {type(x).__name__ for x in b[c] if x is not None}
        same = [x == y or (x is None and y is None) for x, y in zip(a[c], b[c])]
        if not all(same):
            i = same.index(False)
            return f"{same.count(False)} values differ in {c}: {a.iloc[i].to_dict()} != {b.iloc[i].to_dict()}"
        if kinds[0] != kinds[1] and all(kinds):
            return f"types of {c}: {kinds}"
    return ""


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, folder).toPandas()
            took = time.time() - start
            if name not in SQL:
                print(f"{name:24} rows only {len(got):7} {took:6.2f}s", flush=True)
                continue
            message = differences(got, con.sql(SQL[name]).df())
        except Exception as e:  # noqa: BLE001 - report every query
            took, message = time.time() - start, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(message)
        print(f"{name:24} {'FAIL ' + message if message else 'ok'} {took:6.2f}s", flush=True)
    print(f"{bad} of {len(names)} differ")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
