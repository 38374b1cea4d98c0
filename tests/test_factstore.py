"""Stored fact tables: one commit for all, and only the buckets of marked files written."""

import os

import pytest
from pyspark.sql import functions as F

from srclake.operators.factstore import FactStore


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files_of(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


@pytest.fixture
def facts(spark, tmp_path):
    folder = str(tmp_path / "facts")
    tables = {
        "loc": spark.createDataFrame([(i, i * 10) for i in range(300)] + [(None, -1)], "file_id long, lines int"),
        "log": spark.createDataFrame([(i, f"m{i}") for i in range(0, 300, 3)], "file_id long, message string"),
    }
    return FactStore.create(spark, folder, tables, 16), folder


def test_only_touched_buckets_are_written(spark, facts):
    fs, folder = facts
    before = files_of(folder)
    marked = spark.createDataFrame([(3,), (7,), (None,)], "file_id long")
    new = {"loc": spark.createDataFrame([(3, 33), (1000, 5)], "file_id long, lines int")}
    old_loc = rows(fs.read("loc"))
    after = fs.replace(marked, new)
    now = files_of(folder)
    assert {k: now[k] for k in before} == before and len(now) - len(before) <= 2 * 3
    want = [r for r in old_loc if r[0] not in (3, 7)] + [(3, 33), (1000, 5)]
    assert rows(after.read("loc")) == sorted(want, key=repr)
    assert rows(after.read("log")) == sorted(((i, f"m{i}") for i in range(0, 300, 3) if i != 3), key=repr)
    assert rows(fs.read("loc")) == old_loc  # a reader of the old version
    after.vacuum()
    assert rows(FactStore(spark, folder).read("loc")) == sorted(want, key=repr) and len(files_of(folder)) < len(now)


def test_a_run_that_stops_between_two_tables(spark, facts, monkeypatch):
    fs, folder = facts
    want = {t: rows(fs.read(t)) for t in ("loc", "log")}
    written, write = [], FactStore._write

    def stop(self, name, df):
        if written:
            raise RuntimeError("killed")
        written.append(name)
        return write(self, name, df)

    monkeypatch.setattr(FactStore, "_write", stop)
    with pytest.raises(RuntimeError):
        fs.replace(spark.createDataFrame([(3,)], "file_id long"), {})
    monkeypatch.undo()
    again = FactStore(spark, folder)
    assert written == ["loc"] and {t: rows(again.read(t)) for t in want} == want
    assert rows(again.replace(spark.createDataFrame([(3,)], "file_id long"), {}).read("log")) == [r for r in want["log"] if r[0] != 3]


def test_second_writer_fails(spark, facts):
    fs, folder = facts
    other = FactStore(spark, folder)
    fs.replace(spark.createDataFrame([(1,)], "file_id long"), {})
    with pytest.raises(Exception, match="exist"):
        other.replace(spark.createDataFrame([(2,)], "file_id long"), {})


@pytest.mark.parametrize("percent", [10, 0])
def test_incremental_run_equals_a_rebuild(spark, facts, percent):
    fs, folder = facts
    files = spark.createDataFrame([(i, f"/f{i}") for i in range(301)], "file_id long, path string")
    old = spark.createDataFrame([(f"/f{i}", "a") for i in range(300)], "path string, hash string")
    new = spark.createDataFrame([(f"/f{i}", "b" if i in (3, 9) else "a") for i in range(1, 301)], "path string, hash string")
    includes = spark.createDataFrame([(5, 3), (6, 5), (7, 8)], "includer long, included long")
    parse = lambda f: {"loc": f.select("file_id", (F.col("file_id") + 1000).cast("int").alias("lines"))}
    indexed = lambda f, made: {"log": f.join(made["loc"], "file_id").select("file_id", F.col("lines").cast("string").alias("message"))}
    out, report = fs.run(files, old, new, includes, parse, indexed, percent)
    assert report == {"changed": 3, "total": 300, "full": percent == 0}
    marked = set(range(301)) if percent == 0 else {0, 3, 5, 6, 9, 300}
    loc = {i: 1000 + i if i in marked else i * 10 for i in range(1, 301)}
    log = {i: f"m{i}" for i in range(0, 300, 3) if i not in marked} | {i: str(1000 + i) for i in marked if i}
    assert rows(out.read("loc")) == sorted([*loc.items(), (None, -1)], key=repr) and rows(out.read("log")) == sorted(log.items(), key=repr)
