"""Every catalogue query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidewater.plans import catalogue, oracles

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def norm(v):
    return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.7g}" if isinstance(v, float) else str(v)


def test_names_match():
    assert set(catalogue.QUERIES) == set(oracles.SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    told = duck.sql(oracles.SQL[name])
    assert sorted(told.columns) == cols
    rows = [dict(zip(told.columns, r, strict=True)) for r in told.fetchall()]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(r[c]) for c in cols) for r in rows)
