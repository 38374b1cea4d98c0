"""The folder that all executors share: cut lineage, manifests that commit several tables at once, and the schemas of
the fact tables."""

from __future__ import annotations

import contextlib
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset (tests) a temporary one is set."""
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="srclake-"))
    return spark.sparkContext.getCheckpointDir()


#: Has Spark delete an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a write within are deleted when it ends, not once the driver happens to collect garbage."""
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, old)


def cut(df: DataFrame) -> DataFrame:
    """df stored with checkpoint() in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df stored as a compressed Parquet table in the shared folder; the shuffle files that it was made from go.

    checkpoint() writes whole rows with each string in full, and leaves shuffles until the driver collects garbage."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, *paths: str) -> None:
    """Tables that no reader needs any more."""
    for path in paths:
        fs, p = _hadoop(spark, path)
        fs.delete(p, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = _hadoop(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def renamed(spark: SparkSession, draft: str, final: str) -> None:
    """Gives a whole table its name; if another writer's has it already, that one stays and the draft goes."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    (fs, a), (_, b) = _hadoop(spark, draft), _hadoop(spark, final)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(a), fs.makeQualified(b), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception:
        if not fs.exists(b):
            raise
        fs.delete(a, True)


class Manifest:
    """Numbered JSON files in a folder's `_manifest`, the last of which names the live tables.

    Tables are written first, under new names; a commit is one rename to the next number, which fails if another writer
    took it.  A run that stops before that leaves the old state, and files that nothing names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.seen = -1

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for f in listed(self.spark, f"{self.folder}/_manifest") if (m := re.fullmatch(r"(\d+)\.json", f)))

    def current(self) -> dict | None:
        found = self._numbers()
        if not found:
            return None
        self.seen = found[-1]
        fs, p = _hadoop(self.spark, f"{self.folder}/_manifest/{self.seen}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A").next())
        finally:
            stream.close()

    def commit(self, state: dict) -> int:
        """Makes a state that was derived from the one last read the current one."""
        number = self.seen + 1
        fs, draft = _hadoop(self.spark, f"{self.folder}/_manifest/draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        _, final = _hadoop(self.spark, f"{self.folder}/_manifest/{number}.json")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(fs.makeQualified(draft), fs.makeQualified(final), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        self.seen = number
        return number


#: Fact tables (see FIXTURES.md); readers always pass these.
SCHEMAS = {
    "file": "id long, type string, path string, filename string, parent_id long, content_hash string, parse_status int",
    "file_content": "hash string, content string",
    "ast_node": "id long, entity_hash long, ast_value string, symbol_type string, ast_type string, visible boolean, file_id long, start_line int, start_col int, end_line int, end_col int",
    "function": "ast_node_id long, entity_hash long, qualified_name string, type_hash long, record_hash long, parameters array<long>, locals array<long>, mccabe int, bumpiness int, statement_count int, in_lambda boolean, tags array<string>",
    "record": "ast_node_id long, entity_hash long, qualified_name string, is_lambda boolean, context string, tags array<string>",
    "member_type": "type_hash long, member_ast_node long, member_type_hash long, kind string, visibility string",
    "inheritance": "derived long, base long, is_virtual boolean, visibility string",
    "friendship": "target long, the_friend long",
    "relation": "lhs long, rhs long, kind string",
    "type_dependency": "entity_hash long, dependency_hash long",
    "edge": "id long, src long, dst long, type string",
    "header_inclusion": "includer long, included long",
    "typed_entity": "ast_node_id long, entity_hash long, name string, qualified_name string, type_hash long, kind string",
    "enumeration": "ast_node_id long, entity_hash long, constants array<long>",
    "enum_constant": "ast_node_id long, entity_hash long, name string, qualified_name string, value long",
    "macro_expansion": "ast_node_id long, expansion string",
    "doc_comment": "content_hash long, content string, entity_hash long",
    "build_action": "id long, command string, type string",
    "build_source": "file_id long, action_id long",
    "build_target": "file_id long, action_id long",
    "build_log": "type string, message string, file_id long, start_line int, start_col int, end_line int, end_col int",
    "ast_metric": "ast_node_id long, type int, value double",
    "module_metric": "file_id long, type int, value double",
    "loc_metric": "file_id long, type int, metric int",
    "statistics": "group string, key string, value int",
    "py_name": "id long, ref_id long, parent long, parent_function long, is_definition boolean, is_builtin boolean, is_import boolean, is_call boolean, full_name string, value string, type string, type_hint string, line_start int, line_end int, column_start int, column_end int, file_id long",
    "commit": "oid string, message string, author string, committer string, time long, parents array<string>",
    "blame_line": "path string, line int, commit_oid string",
}


def read(spark, folder: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


def write(df: DataFrame, folder: str, table: str, cluster_by: list[str] | None = None) -> None:
    """One table replaced as a whole; rows sorted within files by the keys that queries filter on."""
    (df.sortWithinPartitions(*cluster_by) if cluster_by else df).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
