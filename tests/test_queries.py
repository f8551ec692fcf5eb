"""Every query with SQL agrees with DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from squadframe.plans import catalog, oracle

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in oracle.SQL:
        got = db.execute(oracle.SQL[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == cols
        assert rows == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["bucket", "stat_id"]
    assert set(oracle.SQL) <= set(entry.queries())
