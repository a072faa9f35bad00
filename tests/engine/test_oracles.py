"""Every registered query against its oracle SQL on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from docloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BASE = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(BASE, t)}.parquet'")
    return c


def value(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([str(x) for x in v])
    if v is None or pd.isna(v):
        return None
    if isinstance(v, (str, bool)):
        return v
    return round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "item") else str(v)


def rows(frame, columns):
    return sorted((tuple(value(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, con, name):
    got, want = QUERIES[name](spark, BASE).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, BASE).count() > 0


def test_flagship(spark):
    out = registry.flagship(spark, BASE)
    assert "score_fused" in out.columns and out.count() > 0
