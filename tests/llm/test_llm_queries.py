"""Queries of the training-data operators against their SQL, at the smallest scale."""

import os
from collections import Counter

import duckdb
import pytest

from srclake.llm import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = db.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_names():
    assert [n.split("_")[0] for n in sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, len(registry.queries()) + 1)]
