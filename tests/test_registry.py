"""Registered graph queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from graphweft.plans import registry

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"components_active", "components_within_cluster"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/sf0.001/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if pd.isna(x) else repr(float(x)) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(registry.SQL) - SLOW))
def test_matches_sql(spark, duck, name):
    got, expected = registry.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 1
