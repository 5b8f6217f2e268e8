import duckdb
import pytest

import __spark_entry__ as e
from quirework.plans import registry
from quirework.plans.fixtures import BASE

TABLES = (*BASE, "labels", "embeddings")


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def same(v):
    return None if v is None or v != v else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    got = sorted(repr(tuple(same(r[c]) for c in sorted(df.columns))) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = con.sql(sql)
    at = [want.columns.index(c) for c in sorted(df.columns)]
    assert sorted(want.columns) == sorted(df.columns)
    assert got == sorted(repr(tuple(same(r[i]) for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
