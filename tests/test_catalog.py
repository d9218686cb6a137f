"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest
from conftest import SMALL

from cutscape.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables are not here")


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(same, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(same(r[c]) for c in cols)) for r in df.collect())
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(same(r[i]) for i in at)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
