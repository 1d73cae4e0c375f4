"""Compare registered queries with their SQL in DuckDB.

    python -m tests.oracle_check [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]")
        elif pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype("boolean")
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame, exact: bool = True) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    try:
        pd.testing.assert_frame_equal(
            canonical(got),
            canonical(want),
            check_dtype=False,
            check_exact=exact,
        )
    except AssertionError as e:
        return str(e).replace("\n", " ")[:400]
    return None


def main(argv: list[str]) -> int:
    from sugarline.session import build_session
    from __spark_entry__ import oracle_sql, queries

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session(
        "oracle-check",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            got = frame.toPandas()
            seconds = time.time() - start
            sql = oracle_sql().get(name)
            error = difference(got, con.execute(sql).df()) if sql else None
        except Exception as e:  # reported per query
            error, got, seconds = f"{type(e).__name__}: {str(e)[:600]}", [], time.time() - start
        failed += error is not None
        print(f"{'FAIL' if error else 'ok  '} {name:30s} {len(got):7d} rows {seconds:6.2f}s {error or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
