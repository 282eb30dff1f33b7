"""Every core query with SQL gives the same rows in both engines; the others run and can be repeated."""

import os

import pytest

from corpusloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return db


def rounded(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(rounded(r[c]) for c in columns) for r in df.collect())
    if sql := catalogue.oracle_sql().get(name):
        found = duck.execute(sql)
        at = [x[0] for x in found.description]
        assert got == sorted(tuple(rounded(r[at.index(c)]) for c in columns) for r in found.fetchall())
    assert len(got) == len(set(got)) or name in ("knn",)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
