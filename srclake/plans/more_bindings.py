"""Queries of the scalar functions, predicates, source and maintenance operators, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import store
from ..functions import expr
from ..operators import factstore, history, index, maintenance, paths
from ..operators.nav import Navigation
from ..sources import files
from . import views as v
from .bindings import _SQL, _index, _runs, ints, long, query
from .nav_bindings import NODES, _facts


@query("prd1_equality", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' AND o_totalprice IS NOT NULL")
def _(x):
    return x.table("orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "1-URGENT") & F.col("o_totalprice").isNotNull()).select("o_orderkey")


@query("prd2_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (1, 2, 3, 5, 8, 13, 21)")
def _(x):
    return x.table("lineitem").where(F.col("l_partkey").isin(1, 2, 3, 5, 8, 13, 21)).select("l_orderkey", "l_linenumber")


@query("prd4_contains", "SELECT p_partkey FROM part WHERE contains(lower(p_brand), 'and#1')")
def _(x):
    return x.table("part").where(expr.contains_ignore_case("p_brand", F.lit("AND#1"))).select("p_partkey")


@query("prd7_before", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 3 OR l_linenumber = 3 AND l_quantity < 20")
def _(x):
    return x.table("lineitem").where(expr.before("l_linenumber", "l_quantity", F.lit(3), F.lit(20))).select("l_orderkey", "l_linenumber")


_RANGE = "SELECT l_orderkey, l_linenumber, l_linenumber AS sl, l_suppkey % 5 AS sc, l_linenumber + l_partkey % 3 AS el, l_partkey % 7 AS ec FROM lineitem"


@query("prd8_inside", f"SELECT l_orderkey, l_linenumber FROM ({_RANGE}) WHERE CASE WHEN (sl, sc) = (2, 2) THEN (el, ec) < (4, 3) WHEN (el, ec) = (4, 3) THEN (2, 2) < (sl, sc) ELSE (2, 2) < (sl, sc) AND (el, ec) < (4, 3) END")
def _(x):
    line, supplier, part = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    a = F.struct(line.cast("long").alias("start_line"), (supplier % 5).cast("long").alias("start_col"), (line + part % 3).cast("long").alias("end_line"), (part % 7).cast("long").alias("end_col"))
    b = F.struct(*(F.lit(n).cast("long").alias(c) for c, n in (("start_line", 2), ("start_col", 2), ("end_line", 4), ("end_col", 3))))
    return x.table("lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b")).where(expr.range_inside("a", "b")).select("l_orderkey", "l_linenumber")


@query("prd12_names", "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'first' WHEN 2 THEN 'second' END AS name FROM lineitem")
def _(x):
    return x.table("lineitem").select("l_orderkey", "l_linenumber", expr.named(F.col("l_linenumber").cast("int"), {1: "first", 2: "second"}).alias("name"))


@query("so2_sorted_unique", "SELECT DISTINCT l_partkey AS id FROM lineitem ORDER BY id")
def _(x):
    return x.table("lineitem").select(F.col("l_partkey").alias("id")).dropDuplicates(["id"]).orderBy("id")


@query("so9_log_offset", f"SELECT oid, time FROM {v.COMMITS} WHERE contains(message, 'err') ORDER BY time DESC, oid LIMIT 10 OFFSET 5")
def _(x):
    return history.log(x.commits(), 10, 5, "ERR").select("oid", "time")


@query("fn2_sha1", "SELECT doc_id, sha1(text) AS h FROM documents")
def _(x):
    return x.table("documents").select("doc_id", expr.sha1("text").alias("h"))


@query("fn5_line_count", f"SELECT id, CASE WHEN content <> '' THEN {ints('len(string_split(content, chr(10)))')} END AS n FROM {v.FILES}")
def _(x):
    return x.files().select("id", expr.line_count("content").cast("long").alias("n"))


@query("fn8_path", f"SELECT id, array_to_string(list_slice(string_split(path, '/'), 1, -2), '/') AS dir, string_split(path, '/')[-1] AS name, len(string_split(path, '/')) - 2 AS depth FROM {v.FILES}")
def _(x):
    return x.files().select("id", expr.parent("path").alias("dir"), expr.filename("path").alias("name"), F.when(F.col("path").isNotNull(), F.size(expr.ancestors("path"))).cast("long").alias("depth"))


@query("fn12_signature", "SELECT c_custkey, c_name || ' (' || c_mktsegment || ')' AS s FROM customer")
def _(x):
    return x.table("customer").select("c_custkey", expr.signature("c_name", "c_mktsegment").alias("s"))


@query("fn15_space_tokens", r"SELECT page_id, len([t FOR t IN regexp_split_to_array(lower(html), '[ \t\n\x0B\f\r]+') IF t <> '']) AS n FROM pages")
def _(x):
    return x.table("pages").select("page_id", F.when(F.col("html").isNotNull(), F.size(expr.space_tokens("html"))).cast("long").alias("n"))


@query("fn18_time_text", "SELECT event_id, strftime(ts, '%a %b %-d %H:%M:%S %Y') AS t FROM events")
def _(x):
    return x.table("events").select("event_id", expr.time_text(F.unix_timestamp("ts")).alias("t"))


@query("fn19_json", "SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS j FROM nation")
def _(x):
    return x.table("nation").select("n_nationkey", expr.as_json("n_name", "n_regionkey").alias("j"))


@query("fn20_power", "SELECT l_orderkey, l_linenumber, round(pow(l_quantity, 2) / (l_linenumber + 1), 6) AS r FROM lineitem")
def _(x):
    return x.table("lineitem").select("l_orderkey", "l_linenumber", F.round(F.pow("l_quantity", F.lit(2)) / (F.col("l_linenumber") + 1), 6).alias("r"))


@query("rf29_source_text", f"SELECT id AS query_id, substr(string_split(content, chr(10))[1], 1, 4) AS text FROM {v.FILES} WHERE content IS NOT NULL")
def _(x):
    f = x.files().where("content IS NOT NULL")
    n = f.select("id", F.col("id").alias("entity_hash"), F.lit("").alias("ast_value"), F.lit("Function").alias("symbol_type"), F.lit("Definition").alias("ast_type"), F.lit(True).alias("visible"), F.col("id").alias("file_id"), *(F.lit(k).alias(c) for c, k in (("start_line", 1), ("start_col", 1), ("end_line", 1), ("end_col", 5))))
    facts = {"ast_node": n, "file": f.select("id", F.col("hash").alias("content_hash")), "file_content": f.select("hash", "content").dropDuplicates(["hash"])}
    return Navigation(facts).source_text(f.select("id"))


@query("gr12_subdirectories", f"SELECT path FROM {v.TREE} WHERE is_dir AND regexp_matches(path, '^/EUROPE/[^/]*$')")
def _(x):
    return paths.children(x.tree().where("is_dir"), "/EUROPE").select("path")


def _lines(terms: str) -> str:
    return f"SELECT doc_id, line AS start_line, start_col, line AS end_line, end_col FROM ({_runs(terms)})"


@query("sr11_matchers", f"""{_lines("term IN ('of', 'with')")} UNION SELECT doc_id, 1, 1, 1, 1 + length(string_split(string_split(text, chr(10))[1], ' ')[1]) FROM documents WHERE string_split(string_split(text, chr(10))[1], ' ')[1] <> ''
UNION SELECT doc_id, first_line, first_col, last_line, last_col FROM ({_SQL["sr20_log_spans"]})""")
def _(x):
    d = x.table("documents")
    tags = d.select("doc_id", F.lit(1).alias("line"), F.substring_index(F.substring_index("text", "\n", 1), " ", 1).alias("name")).where("name <> ''")
    return _index(x).matches(["of", "with"], tags, "with from").select("doc_id", *map(long, ("start_line", "start_col", "end_line", "end_col")))


@query("src19_segments", "SELECT term, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 100 = 0 THEN ['tagged', lang] WHEN doc_id % 100 <> 1 THEN [lang, source] END) AS term FROM documents) WHERE term IS NOT NULL GROUP BY term")
def _(x):
    d = x.table("documents")
    ix = index.build(d.select("doc_id", F.concat_ws(" ", "lang", "source").alias("definition")), f"{store.folder(x.spark)}/index-{uuid.uuid4().hex}")
    ix = ix.set_fields(d.where("doc_id % 100 = 0").select("doc_id", F.concat(F.lit("tagged "), "lang").alias("definition"))).remove(d.where("doc_id % 100 = 1").select("doc_id")).merge()
    return ix.of("definition").groupBy("term").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))


@query("sr14_whole_value", f"SELECT id FROM {v.FILES} WHERE regexp_full_match(lower(path), '/src[0-9]+/(en|de)/.*7')")
def _(x):
    return x.files().where(expr.matches_whole("path", "/src[0-9]+/(en|de)/.*7")).select("id")


@query("in5_metric_cleanup", f"SELECT id, type, value FROM {v.METRICS} WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def _(x):
    return maintenance.cleaned(x.metrics(), x.table("part").where("p_size > 25").select(F.col("p_partkey").alias("id")), "id")


@query("in7_incremental", f"SELECT id AS file_id, CASE WHEN type = 'de' THEN 'new' ELSE 'old' END AS what FROM {v.FILES} WHERE content IS NOT NULL AND path IS NOT NULL")
def _(x):
    f = x.files().where("content IS NOT NULL AND path IS NOT NULL")
    new = f.select("path", F.when(F.col("type") == "de", F.sha1(F.concat("content", F.lit("!")))).otherwise(F.col("hash")).alias("hash"))
    none = f.select(F.col("id").alias("includer"), F.col("id").alias("included")).limit(0)
    known = f.select(F.col("id").alias("file_id"), "path")
    out, _ = maintenance.incremental_run({"loc": known.select("file_id", F.lit("old").alias("what"))}, known, f.select("path", "hash"), new, none, lambda d: {"loc": d.select("file_id", F.lit("new").alias("what"))}, percent=100)
    return out["loc"]


def _files_of(a: str, b: str, kind: str) -> str:
    return f"SELECT DISTINCT a.file_id AS src, b.file_id AS dst, '{kind}' AS type FROM {NODES} a JOIN {NODES} b USING (entity_hash) WHERE a.ast_type IN ({a}) AND b.ast_type IN ({b}) AND a.file_id <> b.file_id"


@query("src8_provide_edges", _files_of("'Definition'", "'Declaration'", "PROVIDE"))
def _(x):
    return files.provide_edges(_facts(x)["ast_node"])


@query("src8_use_edges", _files_of("'Usage', 'VirtualCall'", "'Definition', 'Declaration'", "USE"))
def _(x):
    return files.use_edges(_facts(x)["ast_node"])


_SKIPPED = " OR ".join(f"ends_with(lower(path), '{s}')" for s in files.SKIPPED_SUFFIXES)


@query("src17_indexable", f"SELECT path FROM (SELECT page_id, path, length(html) AS n FROM {v.URLS} JOIN pages USING (page_id)) WHERE n <= 1048576 AND NOT ({_SKIPPED}) AND NOT starts_with(path, '/www.example.com/')")
def _(x):
    f = x.url_files().join(x.table("pages").select("page_id", F.length("html").alias("length")), "page_id").withColumn("plain", F.lit(True))
    return files.indexable(f, ("/www.example.com",)).select("path")


@query("src18_tag_kinds", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Type' WHEN 1 THEN 'Function' WHEN 2 THEN 'Other' END AS kind FROM part")
def _(x):
    k = F.col("p_partkey") % 4
    p = x.table("part").select("p_partkey", F.when(k == 0, "struct").when(k == 1, "method").when(k == 2, "strange").otherwise("prototype").alias("k"))
    return p.select("p_partkey", files.tag_kind("k").alias("kind"))


@query("src19_fields", "SELECT coalesce(o_orderkey, k) AS id, coalesce(v, o_orderstatus) AS status FROM orders FULL JOIN (SELECT DISTINCT l_orderkey * 2 AS k, 'tagged' AS v FROM lineitem) ON k = o_orderkey")
def _(x):
    i = x.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return maintenance.with_field_values(i, x.table("lineitem").select((F.col("l_orderkey") * 2).alias("id"), F.lit("tagged").alias("status")).distinct(), "id", ["status"])


@query("in4_stored_run", f"""WITH f AS (SELECT id, type, length(content) AS n, id % 50 = 0 AS gone FROM {v.FILES} WHERE content IS NOT NULL AND path IS NOT NULL),
c AS (SELECT id FROM f WHERE gone OR id % 70 = 1),
m AS (SELECT id FROM c UNION SELECT id + 1 FROM c WHERE id % 3 = 0 AND id + 1 IN (SELECT id FROM f) UNION SELECT id + 2 FROM c WHERE id % 3 = 0 AND id + 2 IN (SELECT id FROM f) AND id + 1 IN (SELECT id FROM f) AND (id + 1) % 3 = 0)
SELECT id AS file_id, CASE WHEN id IN (SELECT id FROM m) THEN 'new' ELSE 'old' END AS what, {ints('n')} AS n FROM f WHERE NOT gone""")
def _(x):
    f = x.files().where("content IS NOT NULL AND path IS NOT NULL")
    known = f.select(F.col("id").alias("file_id"), "path")
    new = f.where("id % 50 <> 0").select("path", F.when(F.col("id") % 70 == 1, F.sha1(F.concat("content", F.lit("!")))).otherwise(F.col("hash")).alias("hash"))
    length = F.length("content").cast("long").alias("n")
    ids = f.select("id")
    includes = ids.where("id % 3 = 0").select((F.col("id") + 1).alias("includer"), F.col("id").alias("included")).join(ids.select(F.col("id").alias("includer")), "includer", "left_semi")
    facts = factstore.FactStore.create(x.spark, f"{store.folder(x.spark)}/facts-{uuid.uuid4().hex}", {"loc": f.select(F.col("id").alias("file_id"), F.lit("old").alias("what"), length)})
    parse = lambda d: {"loc": d.join(f.select(F.col("id").alias("file_id"), length), "file_id").select("file_id", F.lit("new").alias("what"), "n")}
    out, _ = facts.run(known, f.select("path", "hash"), new, includes, parse)
    return out.read("loc")


_OVERLAY = """SELECT conv_id, turn, role, unnest(CASE WHEN turn % 4 = 1 THEN [] ELSE [0] END || CASE WHEN turn % 3 = 0 THEN [1] ELSE [] END) AS added FROM conversations"""


@query("hs6_uncommitted", f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, added) AS line FROM ({_OVERLAY})),
o AS (SELECT CAST(conv_id AS VARCHAR) AS path, line, CASE WHEN added = 1 THEN repeat('0', 40) ELSE role END AS oid FROM t),
g AS (SELECT *, line - row_number() OVER (PARTITION BY path, oid ORDER BY line) AS g FROM o)
SELECT path, oid AS commit_oid, {ints('min(line)')} AS first_line, count(*) AS n_lines FROM g GROUP BY path, oid, g""")
def _(x):
    c, turn = x.table("conversations"), F.col("turn")
    path = F.col("conv_id").cast("string").alias("path")
    line = F.concat(turn.cast("string"), F.lit(" "), "role")
    kept = F.when(turn % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(line))
    text = lambda lines: c.groupBy(path).agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", lines.alias("l")))), lambda t: t["l"])), "\n").alias("content"))
    working = text(F.concat(kept, F.when(turn % 3 == 0, F.array(F.concat(F.lit("added "), turn.cast("string")))).otherwise(F.array().cast("array<string>"))))
    blame = c.select(path, F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("line"), F.col("role").alias("commit_oid"))
    hunks = history.blame_hunks(history.overlaid(blame, text(F.array(line)), working.where("content <> ''")))
    return hunks.select("path", "commit_oid", long("first_line"), long("n_lines"))
