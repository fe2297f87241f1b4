"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry_points

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in sorted(os.listdir(FOLDER)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def lines(df: pd.DataFrame) -> list:
    def plain(v):
        return None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v

    ordered = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in ordered.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    got = entry_points.queries()[name](spark, FOLDER).toPandas()
    want = tables.execute(entry_points.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert lines(got) == lines(want)


def test_entry(spark):
    out = entry_points.entry(spark).toPandas()
    assert len(out) and (out["n_windows"] > 0).all()


def test_names():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
