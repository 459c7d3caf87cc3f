"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from facetry.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(df: pd.DataFrame) -> list:
    rows = df[sorted(df.columns)].astype(object).values.tolist()
    return sorted(tuple("" if x is None or x != x else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), db.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
