"""Every named query against its SQL, over whole tables at the smallest scale."""

import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry_point

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "events documents embeddings pages benchmark labels conversations".split()
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if pd.isna(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return int(v) if v == math.floor(v) else round(v, 9)
    return v


def rows(df):
    columns = sorted(df.columns)
    data = [tuple(norm(v) for v in r) for r in df[columns].astype(object).itertuples(index=False, name=None)]
    return columns, sorted(data, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, con, name):
    got = entry_point.queries()[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(got) == rows(con.execute(SQL[name]).df())
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
