"""Run every query against its SQL: python tests/check_oracle.py [sf_dir] [names...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(object)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].astype(object).where(df[c].notna(), None)
    return df.sort_values(list(df.columns), na_position="first", key=lambda s: s.astype(str) if s.dtype == object else s).reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """None when both hold the same rows, else what differs."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} / {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} / {len(sql_rows)}"
    left, right = normal(spark_rows), normal(sql_rows)
    for c in left.columns:
        if left[c].dtype == float and right[c].dtype == float:
            same = np.isclose(left[c], right[c], rtol=1e-12, atol=0, equal_nan=True)
        else:
            same = (left[c] == right[c]) | (left[c].isna() & right[c].isna())
        if not same.all():
            bad = np.flatnonzero(~np.asarray(same))
            return f"{c}: {len(bad)} rows differ, first {left.loc[bad[0]].to_dict()} / {right.loc[bad[0]].to_dict()}"
    return None


def main() -> int:
    import __spark_entry__ as entry

    from ensemblescope import get_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("check", "local[8]")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    names = sys.argv[2:] or list(entry.queries())
    failed = []
    for name in names:
        start = time.time()
        try:
            rows = entry.queries()[name](spark, sf_dir).toPandas()
            took = time.time() - start
            found = difference(rows, con.execute(sql[name]).df()) if name in sql else "rows only"
        except Exception as error:  # noqa: BLE001
            took, rows, found = time.time() - start, [], f"{type(error).__name__}: {str(error)[:600]}"
        good = found in (None, "rows only")
        if not good:
            failed.append(name)
        print(f"{'ok  ' if good else 'FAIL'} {name:24s} {len(rows):7d} rows {took:6.2f}s {found or ''}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} good; failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
