"""Runs a query and its DuckDB SQL over one folder of tables, and compares the rows."""

import os

import duckdb
import pandas as pd


def connection(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def assert_same(got, want):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(got.astype(object).where(got.notna(), None), want.astype(object).where(want.notna(), None), check_dtype=False, rtol=1e-9, atol=1e-9)
