"""Every registered query runs, and those with SQL agree with DuckDB."""
import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

from .conftest import SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")

    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "NULL"
        return repr(float(x)) if isinstance(x, (float, np.floating)) else str(x)

    return list(df.columns), sorted(tuple(cell(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck.execute(ORACLES[name]).df())
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["date_utc", "aqi", "category", "dominant"]


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
