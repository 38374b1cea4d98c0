"""Source trees, build databases, project metadata and dumps of history (SRC1-SRC6, SRC15-SRC18, SNK*)."""

from __future__ import annotations

import json
import shlex

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import paths
from ..operators.graph import Graph

#: Suffixes that are not indexed (fixed values; compared in lower case), and the size of the largest file that is.
SKIPPED_SUFFIXES = (".doc", ".rtf", ".htm", ".html", ".xml", ".cc.d", ".cc.opts", ".bin", ".hhk", ".hhc", ".output", ".output.0", ".output.1", ".metrics.dat", ".pp")
MAX_INDEXED = 1 << 20
CPP_SUFFIXES = (".c", ".cc", ".cpp", ".cxx")
#: Generic kinds of definition tags, by the tagger's names (fixed values); declarations only are no definitions.
KIND_NAMES = {
    "Type": ["struct", "class", "interface", "typedef", "union", "enum", "table", "type", "record", "Exception", "namelist"],
    "Macro": ["define", "macro"],
    "Function": ["subroutine", "function", "method", "procedure", "singleton method", "jsfunction", "Constructor", "entry"],
    "Field": ["member", "field", "property"],
    "Variable": ["externvar", "variable", "local", "external variable declarations", "var"],
    "Constant": ["enumerator", "constant", "enum constant", "null"],
    "Label": ["label"],
    "Module": ["namespace", "package", "module", "component", "program", "block data", "common"],
}
NOT_DEFINITIONS = ["prototype", "subroutine declaration", "event", "section", "command"]
KINDS = {name: kind for kind, names in KIND_NAMES.items() for name in names}


def walk(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """SRC1: path, modificationTime, length, content of all files below a root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def is_plain_text(content):
    """SRC4 (approximation): no NUL and valid UTF-8."""
    text = content.cast("string")
    return ~F.contains(text, F.lit("\x00")) & F.is_valid_utf8(text)


def register(walked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC2, SRC3: file rows (with their directories) and distinct contents; NUL is a space in contents."""
    f = walked.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.unix_timestamp("modificationTime").alias("timestamp"), F.col("content").cast("string").alias("text"), is_plain_text(F.col("content")).alias("plain"))
    f = f.withColumn("text", F.translate("text", "\x00", " "))
    suffix = expr.extension("path")
    kind = F.when(~F.col("plain"), "Binary").when(suffix.isin(*CPP_SUFFIXES, ".h", ".hpp", ".hh", ".hxx"), "CPP").when(suffix == ".py", "PY").otherwise("Unknown")
    digest = F.sha1("text")
    cols = [expr.fnv1a("path").alias("id"), "type", "path", expr.filename("path").alias("filename"), expr.fnv1a(expr.parent("path")).alias("parent_id"), "content_hash", F.lit(0).alias("parse_status")]
    files = f.select(kind.alias("type"), "path", digest.alias("content_hash"))
    dirs = paths.directories(f).select(F.lit("Dir").alias("type"), "path", F.lit(None).cast("string").alias("content_hash"))
    contents = f.where("plain").select(digest.alias("hash"), F.col("text").alias("content")).dropDuplicates(["hash"])
    return files.unionByName(dirs).select(*cols), contents


def indexable(files: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """SRC17: path, length, plain."""
    ok = F.col("plain") & (F.col("length") <= MAX_INDEXED)
    for s in SKIPPED_SUFFIXES:
        ok = ok & ~F.endswith(F.lower("path"), F.lit(s))
    for d in skip:
        ok = ok & ~expr.under("path", F.lit(d))
    return files.where(ok)


def inputs_and_outputs(command: str) -> tuple[list[str], list[str], str]:
    """SRC6: sources, outputs and kind (Compile or Link) of one command."""
    words = shlex.split(command)
    sources = [w for w in words[1:] if w.lower().endswith(CPP_SUFFIXES)]
    objects = [w for w in words[1:] if w.endswith((".o", ".a", ".so"))]
    out = [words[i + 1] for i, w in enumerate(words[:-1]) if w == "-o"]
    if "-c" in words:
        return sources, out or [s.rsplit(".", 1)[0] + ".o" for s in sources], "Compile"
    return sources + [o for o in objects if o not in out], out or ["a.out"], "Link"


def build_actions(spark: SparkSession, database: str, seen: DataFrame | None = None) -> DataFrame:
    """SRC5, SRC6: id (hash of the command), command, type, sources, targets; commands in `seen` (command) are skipped."""
    raw = spark.read.schema("directory string, command string, arguments array<string>, file string").json(database, multiLine=True)
    c = raw.select(F.coalesce("command", F.array_join("arguments", " ")).alias("command"), "file").where(F.lower("file").rlike(r"\.(c|cc|cpp|cxx)$"))
    c = c.select("command").distinct()
    if seen is not None:
        c = c.join(seen.select("command").distinct(), "command", "left_anti")

    def run(batches):
        for pdf in batches:
            got = [inputs_and_outputs(x) for x in pdf["command"]]
            yield pd.DataFrame({"id": pdf["id"], "command": pdf["command"], "type": [g[2] for g in got], "sources": [g[0] for g in got], "targets": [g[1] for g in got]})

    return c.select(F.xxhash64("command").alias("id"), "command").mapInPandas(run, "id long, command string, type string, sources array<string>, targets array<string>")


def includes(files: DataFrame) -> DataFrame:
    """SRC9 by text: path, included, system (from #include lines)."""
    hit = F.regexp_extract_all("content", F.lit(r'(?m)^[ \t]*#[ \t]*include[ \t]*([<"][^>"\n]+)[>"]'), F.lit(1))
    return files.select("path", F.explode(hit).alias("i")).select("path", F.substring("i", 2, 1 << 20).alias("included"), F.startswith("i", F.lit("<")).alias("system"))


def provide_edges(nodes: DataFrame) -> DataFrame:
    """SRC8: definition file -> declaration file of the same entity, once each."""
    d = nodes.where("ast_type = 'Definition'").select("entity_hash", F.col("file_id").alias("src")).distinct()
    e = nodes.where("ast_type = 'Declaration'").select("entity_hash", F.col("file_id").alias("dst")).distinct()
    return d.join(e, "entity_hash").where("src <> dst").select("src", "dst", F.lit("PROVIDE").alias("type")).distinct()


def use_edges(nodes: DataFrame) -> DataFrame:
    """SRC8: user file -> file of the used entity's declarations or definitions."""
    u = nodes.where("ast_type IN ('Usage', 'VirtualCall')").select("entity_hash", F.col("file_id").alias("src")).distinct()
    d = nodes.where("ast_type IN ('Definition', 'Declaration')").select("entity_hash", F.col("file_id").alias("dst")).distinct()
    return u.join(d, "entity_hash").where("src <> dst").select("src", "dst", F.lit("USE").alias("type")).distinct()


def tag_kind(kind):
    """SRC18: the generic kind; null for what is no definition."""
    return F.when(~F.col(kind).isin(*NOT_DEFINITIONS), F.coalesce(expr.named(F.col(kind), KINDS), F.lit("Other")))


def git_log(spark: SparkSession, dump: str) -> DataFrame:
    """SRC15: commits of a dump made by git log --format=%H%x09%P%x09%an%x09%cn%x09%ct%x09%s."""
    c = F.split("value", "\t")
    return spark.read.text(dump).select(c[0].alias("oid"), c[5].alias("message"), c[2].alias("author"), c[3].alias("committer"), c[4].cast("long").alias("time"), F.filter(F.split(c[1], " "), lambda p: p != "").alias("parents"))


def project_info(spark: SparkSession, path: str) -> DataFrame:
    """SNK6: labels, database and description of a project."""
    return spark.read.schema("labels map<string,string>, database string, description string").json(path, multiLine=True)


def labels(info: DataFrame) -> DataFrame:
    return info.select(F.explode("labels").alias("label", "path"))


def dot(graph: Graph, name: str = "G", limit: int = 10_000) -> str:
    """SNK4: DOT text of a diagram of at most `limit` edges (more raise an error: a diagram is for one reader)."""
    q = lambda x: json.dumps(str(x))
    attrs = lambda m: (" [" + ", ".join(f"{k}={q(v)}" for k, v in sorted(m.items())) + "]") if m else ""
    edges = graph.edges.limit(limit + 1).collect()
    nodes = graph.nodes.limit(2 * limit + 2).collect()
    if len(edges) > limit:
        raise ValueError(f"more than {limit} edges")
    node = {r["id"]: f"{q(r['id'])}{attrs(r['attrs'])};" for r in nodes}
    cluster = {r["cluster"]: (r["parent"], r["attrs"]) for r in graph.clusters.limit(limit + 1).collect()}
    inside: dict = {}
    for r in graph.members.limit(2 * limit + 2).collect():
        if r["cluster"] in cluster and r["id"] in node:
            inside.setdefault(r["cluster"], []).append(node.pop(r["id"]))
    below: dict = {}
    for c, (parent, _) in cluster.items():
        below.setdefault(parent if parent in cluster else None, []).append(c)

    def block(c: str, pad: str) -> list[str]:
        own = [f"{pad}  {k}={q(v)};" for k, v in sorted((cluster[c][1] or {}).items())]
        rest = [x for d in sorted(below.get(c, [])) for x in block(d, pad + "  ")]
        return [f"{pad}subgraph {q(f'cluster_{c}')} {{", *own, *rest, *(f"{pad}  {x}" for x in sorted(inside.get(c, []))), f"{pad}}}"]

    lines = [x for c in sorted(below.get(None, [])) for x in block(c, "  ")]
    lines += sorted(f"  {x}" for x in node.values()) + sorted(f"  {q(r['src'])} -> {q(r['dst'])}{attrs(r['attrs'])};" for r in edges)
    return "\n".join([f"digraph {name} {{", *lines, "}"])


def save_table(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 64) -> None:
    """SNK1, SNK3: one atomic overwrite; bucketed by the key that indexes would have."""
    w = df.write.mode("overwrite")
    (w.bucketBy(buckets, bucket_by).sortBy(bucket_by) if bucket_by else w).saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """SNK1."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
