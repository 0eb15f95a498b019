"""Every catalogued query runs; those with SQL give its rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (d[cols].astype(str).sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b) and not (a != b).any(axis=1).any()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_without_sql(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["r", "c", "v", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
