"""Every query with SQL gives the SQL's rows, at the smallest scale."""

import math
import os
from collections import Counter

import duckdb
import pytest

from srclake.plans import bindings

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = bindings.queries(), bindings.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def same(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(same(r[c]) for c in cols) for r in df.collect())
    if name in SQL:
        rel = db.sql(SQL[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == Counter(tuple(same(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
