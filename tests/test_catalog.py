"""Registered queries against SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in sorted(set(entry.oracle_sql()) - {"pipeline"}) if not n.startswith("op")]


def normal(df):
    df = df[sorted(df.columns)]
    text = lambda x: "none" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)
    rows = [tuple(text(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x) for x in r) for r in df.astype(object).where(pd.notna(df), None).itertuples(index=False)]
    return list(df.columns), sorted(rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert normal(got) == normal(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
