"""Every registered query against its SQL oracle, on the smallest sample."""

import os

import pandas
import pytest

import __spark_entry__ as contract
from footfall.plans import oracle, queries

SAMPLE = "/root/testdata/sf0.001"
QUERIES, ORACLE = queries.queries(), oracle.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SAMPLE), reason="sample tables not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in os.listdir(SAMPLE):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SAMPLE}/{file}'")
    return connection


def plain(value):
    if pandas.isna(value):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    try:
        return round(float(value), 6) if not isinstance(value, str) else value
    except TypeError:
        return str(value)


def normal(frame):
    frame = frame[sorted(frame.columns)]
    for column in frame.columns:
        if str(frame[column].dtype).startswith("datetime"):
            frame = frame.assign(**{column: frame[column].astype("datetime64[us]").astype(str)})
    return sorted((tuple(map(plain, row)) for row in frame.itertuples(index=False)), key=repr)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES) <= set(contract.queries())


def test_entry(spark):
    assert [r["count"] for r in contract.entry(spark).collect()][0] > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SAMPLE).toPandas()
    expected = duck.execute(ORACLE[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert normal(found) == normal(expected)
