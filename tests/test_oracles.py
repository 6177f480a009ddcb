"""Every query of the library against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from plenogrid import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype("float64") + 0.0
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_sql_has_queries():
    assert set(plans.ORACLES) <= set(plans.QUERIES)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    a, b = canon(plans.QUERIES[name](spark, sf).toPandas()), canon(duck.sql(plans.ORACLES[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), f"{c}: {a[c][~same].iloc[0]!r} {b[c][~same].iloc[0]!r}"
