"""Fact tables stored together: dealt to buckets by file, changed by one commit (SNK3, IN4, IN7).

A manifest names the folder of each table's buckets.  A change writes the buckets that hold marked files under new
names, for all tables, and commits them with one new manifest: readers see all tables before it or all after it, and a
run that stops on its way leaves the old version.  So facts need not go layer by layer, as a database with foreign keys
would have it.  Buckets without marked files are neither read nor written.  Tables have a file_id; rows without one are
of bucket 0 and stay.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import store
from . import maintenance

BUCKETS = 64
BUCKET = "_bucket"


class FactStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.manifest = store.Manifest(spark, folder)
        self.state = self.manifest.current()

    @classmethod
    def create(cls, spark: SparkSession, folder: str, tables: dict[str, DataFrame], buckets: int = BUCKETS) -> FactStore:
        """A new version with these tables alone."""
        out = cls(spark, folder)
        out.state = {"buckets": buckets, "tables": {}, "schemas": {name: df.schema.json() for name, df in tables.items()}}
        for name, df in tables.items():
            out.state["tables"][name] = out._write(name, df)
        out.manifest.commit(out.state)
        return cls(spark, folder)

    def _bucket(self) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(F.col("file_id").cast("long")), F.lit(self.state["buckets"])).cast("int"), F.lit(0))

    def _write(self, name: str, df: DataFrame) -> dict[str, str]:
        """The folders of the buckets that df has rows of."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.withColumn(BUCKET, self._bucket()).repartition(BUCKET).sortWithinPartitions(BUCKET, "file_id").write.partitionBy(BUCKET).parquet(path)
        return {n.split("=")[1]: f"{path}/{n}" for n in store.listed(self.spark, path) if n.startswith(f"{BUCKET}=")}

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        paths = [p for b, p in self.state["tables"][name].items() if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(json.loads(self.state["schemas"][name]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, marked: DataFrame, new: dict[str, DataFrame], more: Callable[[FactStore, dict[str, DataFrame]], dict[str, DataFrame]] | None = None) -> FactStore:
        """Facts of marked files (file_id) go, new ones come, in one commit.  more: makes further tables' new rows of the
        store before the change and the new rows."""
        marked = store.cut(marked.select(F.col("file_id").cast("long").alias("file_id")).where("file_id IS NOT NULL").distinct())
        if more:
            new = new | more(self, new)
        new = {name: store.cut(df) for name, df in new.items()}
        state = self.state | {"tables": dict(self.state["tables"])}
        for name in state["tables"]:
            touched = marked.select(self._bucket().alias("b"))
            if name in new:
                touched = touched.union(new[name].select(self._bucket().alias("b")))
            buckets = [r["b"] for r in touched.distinct().collect()]  # as many as there are buckets
            rows = maintenance.cleaned(self.read(name, buckets), marked)
            if name in new:
                rows = rows.unionByName(new[name].select(*rows.columns))
            written = self._write(name, rows)
            state["tables"][name] = {b: p for b, p in state["tables"][name].items() if int(b) not in buckets} | written
        self.manifest.commit(state)
        return FactStore(self.spark, self.folder)

    def run(self, files: DataFrame, old: DataFrame, new: DataFrame, includes: DataFrame, parse: Callable, parse_indexed: Callable | None = None, percent: int = 10) -> tuple[FactStore, dict]:
        """IN1-IN7 on stored tables: marks changed files and their includers; drops their facts; parses those that are
        still there, first what needs no index, then (parse_indexed, given files and the new rows) what does; commits.
        Beyond `percent` of changed files all are parsed anew.

        files: file_id, path of all known and new files; old, new: path, hash; includes: includer, included."""
        changed = maintenance.changes(old, new, added=True)
        ids = store.cut(changed.join(files, "path").select("file_id", "status"))
        n, total = changed.where("status <> 'ADDED'").count(), old.count()
        full = maintenance.needs_full_rebuild(n, total, percent)
        marked = files.select("file_id") if full else maintenance.dependents(includes, ids.select("file_id"))
        present = store.cut(files.join(new.select("path"), "path", "left_semi").join(marked.distinct(), "file_id", "left_semi").select("file_id", "path"))
        more = (lambda _, rows: parse_indexed(present, rows)) if parse_indexed else None
        return self.replace(marked, parse(present), more), {"changed": n, "total": total, "full": full}

    def vacuum(self) -> None:
        """Deletes buckets that the current manifest doesn't name."""
        state = self.manifest.current()
        live = {p for table in state["tables"].values() for p in table.values()}
        for name in store.listed(self.spark, self.folder):
            if name == "_manifest":
                continue
            for b in store.listed(self.spark, f"{self.folder}/{name}"):
                if b.startswith(f"{BUCKET}=") and f"{self.folder}/{name}/{b}" not in live:
                    store.delete(self.spark, f"{self.folder}/{name}/{b}")
