"""Queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from .. import store
from ..operators import graph, history, index, loc, maintenance, metrics, paths, ranges, search, slices
from . import views as v
from .views import Views

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def long(c: str, name: str | None = None):
    return F.col(c).cast("long").alias(name or c)


def ints(c: str) -> str:
    return f"CAST({c} AS BIGINT)"


# --- aggregates ---------------------------------------------------------------------------------------------------


@query("ag1_count", "SELECT count(event_id) AS n FROM events WHERE event_type = 'click' AND value >= 10")
def _(x):
    return x.table("events").where("event_type = 'click' AND value >= 10").agg(F.count("event_id").alias("n"))


@query("ag2_count_distinct", f"SELECT entity, {ints('count(DISTINCT dependency)')} AS n FROM {v.DEPS} GROUP BY entity")
def _(x):
    return x.dependencies().groupBy("entity").agg(F.countDistinct("dependency").alias("n"))


@query("ag3_group_count", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY l_partkey")
def _(x):
    return x.table("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy("l_partkey")


@query("ag4_distinct_types", f"SELECT DISTINCT type FROM {v.FILES} ORDER BY type")
def _(x):
    return x.files().select("type").distinct().orderBy("type")


@query("ag5_multi_group", f"SELECT entity, path, count(*) AS n FROM {v.TYPES} JOIN {v.DEPS} d USING (entity) GROUP BY entity, path")
def _(x):
    return x.types().join(x.dependencies(), "entity").groupBy("entity", "path").agg(F.count("*").alias("n"))


@query("ag6_distinct_view", f"SELECT DISTINCT id, type FROM {v.METRICS} ORDER BY id, type")
def _(x):
    return x.metrics().select("id", "type").distinct()


_STATS = "(SELECT event_type AS grp, 'k' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 4) AS key, count(*) AS value FROM events GROUP BY 1, 2)"


@query("ag7_summary_rollup", f"SELECT grp, key, value FROM {_STATS} UNION ALL SELECT 'Summary', key, {ints('sum(value)')} FROM {_STATS} GROUP BY key")
def _(x):
    s = x.table("events").groupBy(F.col("event_type").alias("grp"), F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 4).cast("string")).alias("key")).agg(F.count("*").alias("value"))
    return metrics.with_summary(s, "grp")


@query("ag8_metrics_list", f"SELECT id, string_agg(type || ':' || n, ',' ORDER BY type) AS metrics FROM (SELECT id, type, count(*) AS n FROM {v.METRICS} GROUP BY id, type) GROUP BY id")
def _(x):
    n = x.metrics().groupBy("id", "type").agg(F.count("*").alias("value"))
    return metrics.metrics_list(n).select("id", F.array_join(F.transform("metrics", lambda m: F.concat_ws(":", m["type"], m["value"])), ",").alias("metrics"))


@query("ag8_metrics_map", f"SELECT id, min(value) FILTER (type = 1) AS quantity, min(value) FILTER (type = 2) AS price, min(value) FILTER (type = 3) AS discount FROM {v.METRICS} GROUP BY id")
def _(x):
    m = metrics.metrics_map(x.metrics())
    return m.select("id", *(F.element_at("metrics", i).alias(n) for i, n in ((1, "quantity"), (2, "price"), (3, "discount"))))


@query("ag9_weighted_sum", "SELECT p_brand AS type_hash, coalesce(sum(l_linenumber), 0)::DOUBLE AS value FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand")
def _(x):
    p = x.table("part").select(F.col("p_brand").alias("type_hash"), "p_partkey")
    m = p.join(x.table("lineitem"), F.col("l_partkey") == F.col("p_partkey"))
    return metrics.type_sum(p.select("type_hash").distinct(), m, "type_hash", "l_linenumber")


@query("ag10_set_size", "SELECT c_nationkey AS type, sum(n)::BIGINT AS n FROM (SELECT l_orderkey, count(DISTINCT p_brand) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(x):
    _, _, methods, uses = x.cohesion()
    return uses.groupBy("method").agg(F.countDistinct("field").alias("k")).join(methods, "method").groupBy("type").agg(F.sum("k").alias("n"))


@query("ag11_ratio", "SELECT o_custkey, CASE WHEN sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 0 THEN 1.0::DOUBLE ELSE round(count(*)::DOUBLE / sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 9) END AS value FROM orders GROUP BY o_custkey")
def _(x):
    g = x.table("orders").groupBy("o_custkey").agg(F.count("*").alias("a"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("b"))
    return g.select("o_custkey", F.round(metrics.ratio("a", "b", 1.0), 9).alias("value"))


@query("ag14_content_length", f"SELECT id, {ints('length(content)')} AS n FROM {v.FILES}")
def _(x):
    return x.files().select("id", F.length("content").cast("long").alias("n"))


# --- joins --------------------------------------------------------------------------------------------------------


@query("jn1_metric_file", f"SELECT t.path, m.type, count(*) AS n FROM {v.METRICS} m JOIN {v.TYPES} t ON t.entity = m.id GROUP BY 1, 2")
def _(x):
    return x.metrics().join(x.types(), F.col("entity") == F.col("id")).groupBy("path", "type").agg(F.count("*").alias("n"))


@query("jn2_dependency_paths", f"SELECT * FROM {v.LOCATED}")
def _(x):
    return metrics.located(x.dependencies(), x.types()).select("entity", "dependency", "entity_path", "dependency_path")


@query("jn3_param_inner", "SELECT o_orderkey AS ast_node_id, count(*)::DOUBLE AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(x):
    p = x.table("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parameters"))
    f = x.table("orders").join(p, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("ast_node_id"), "parameters")
    return metrics.parameter_count(f)


@query("jn4_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def _(x):
    return x.table("orders").join(x.table("lineitem").where("l_quantity >= 49"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("jn5_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def _(x):
    return x.table("orders").join(x.table("lineitem").where("l_quantity >= 49"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


def _contained(op: str, name: str):
    return f"SELECT file_id, scope, count(*) AS n FROM (SELECT doc_id AS file_id, line, ordinal FROM {v.TOKEN_LINES} WHERE term = 'the') t JOIN {v.SCOPES} s USING (file_id) WHERE (line > start_line OR (line = start_line AND ordinal >= 0)) AND (line < end_line OR (line = end_line AND ordinal + 1 {op} 1000000)) GROUP BY file_id, scope"


@query("jn6_calls_within", _contained("<", "jn6"))
def _(x):
    return ranges.within(x.nodes("the"), x.scopes(), bucket_lines=64).groupBy(F.col("outer.file_id").alias("file_id"), F.col("outer.scope").cast("long").alias("scope")).agg(F.count("*").alias("n"))


@query("jn7_enclosing", f"SELECT file_id, line, ordinal, min(scope) AS scope FROM (SELECT doc_id AS file_id, line, ordinal FROM {v.TOKEN_LINES} WHERE term = 'with') t JOIN {v.SCOPES} s USING (file_id) WHERE line BETWEEN start_line AND end_line GROUP BY 1, 2, 3")
def _(x):
    e = ranges.enclosing(x.nodes("with"), x.scopes(), bucket_lines=64)
    return e.groupBy(F.col("inner.file_id").alias("file_id"), F.col("inner.start_line").cast("long").alias("line"), F.col("inner.start_col").cast("long").alias("ordinal")).agg(F.min("outer.scope").cast("long").alias("scope"))


@query("jn8_inclusive", _contained("<=", "jn8"))
def _(x):
    return ranges.within_inclusive(x.nodes("the"), x.scopes(), "file_id", bucket_lines=64).groupBy(F.col("outer.file_id").alias("file_id"), F.col("outer.scope").cast("long").alias("scope")).agg(F.count("*").alias("n"))


@query("jn9_innermost", "SELECT doc_id AS point_id, ((lines - 1) // 2)::BIGINT AS id FROM (SELECT doc_id, len(string_split(text, chr(10))) AS lines FROM documents WHERE text IS NOT NULL)")
def _(x):
    s = x.scopes().select("file_id", F.col("scope").cast("long").alias("id"), F.lit(True).alias("visible"), "start_line", "start_col", "end_line", "end_col")
    whole = x.scopes().groupBy("file_id").agg(F.max("end_line").alias("e")).select("file_id", F.lit(-1).cast("long").alias("id"), F.lit(True).alias("visible"), F.lit(1).alias("start_line"), F.lit(0).alias("start_col"), F.col("e").cast("int").alias("end_line"), F.lit(1_000_001).alias("end_col"))
    p = x.table("documents").where("text IS NOT NULL").select(F.col("doc_id").alias("file_id"), F.col("doc_id").alias("point_id"), F.size(F.split("text", "\n")).alias("line"), F.lit(0).alias("col"))
    return ranges.innermost(p, s.unionByName(whole)).select("point_id", "id")


@query("jn10_shortest_at", f"SELECT doc_id * 1000000 + line AS point_id, arg_min(ordinal, length(term) * 1000000 + ordinal)::BIGINT AS id FROM {v.TOKEN_LINES} GROUP BY doc_id, line")
def _(x):
    t = search.token_lines(x.table("documents"))
    n = t.select(F.col("doc_id").alias("file_id"), F.col("ordinal").cast("long").alias("id"), F.col("term").alias("value"), F.col("line").alias("line_start"), F.lit(0).alias("column_start"), F.lit(9).alias("column_end"))
    p = t.select(F.col("doc_id").alias("file_id"), (F.col("doc_id") * 1_000_000 + F.col("line")).alias("point_id"), "line", F.lit(5).alias("col")).distinct()
    return ranges.shortest_at(p, n).select("point_id", "id")


@query("jn11_prefix_members", f"SELECT dir, {ints('count(*)')} AS n FROM {v.TYPES} t JOIN {v.MODULES} m ON {v.under('t.path', 'm.dir')} GROUP BY dir")
def _(x):
    return paths.members(x.types(), x.modules()).groupBy("dir").agg(F.count("*").alias("n"))


@query("jn11_prefix_raw", f"SELECT dir, {ints('count(*)')} AS n FROM {v.TYPES} t JOIN {v.MODULES} m ON t.path LIKE m.dir || '%' GROUP BY dir")
def _(x):
    return paths.members(x.types(), x.modules(), raw_prefix=True).groupBy("dir").agg(F.count("*").alias("n"))


@query("jn12_first_definition", "SELECT l_partkey AS entity_hash, min(l_orderkey * 10 + l_linenumber) AS id FROM lineitem GROUP BY 1")
def _(x):
    n = x.table("lineitem").select(F.col("l_partkey").alias("entity_hash"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return metrics.first_definition(n)


@query("jn13_related_definitions", "SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = c_nationkey")
def _(x):
    o = x.table("orders").select("o_orderkey", "o_custkey")
    li = x.table("lineitem").select("l_orderkey", "l_suppkey")
    y = x.table("customer").join(o, F.col("o_custkey") == F.col("c_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    return y.join(x.table("supplier"), (F.col("s_suppkey") == F.col("l_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).select("c_custkey", "s_suppkey").distinct()


@query("jn14_two_hop", "SELECT a.l_suppkey AS start, b.l_partkey AS node FROM lineitem a JOIN lineitem b USING (l_orderkey)")
def _(x):
    li = x.table("lineitem")
    targets = li.select(F.col("l_suppkey").alias("file_id"), F.col("l_orderkey").alias("action_id"))
    sources = li.select(F.col("l_partkey").alias("file_id"), F.col("l_orderkey").alias("action_id"))
    return graph.build_sources(targets, sources, targets.select("file_id").distinct())


@query("jn15_longest_prefix", f"SELECT path, max(root) AS root FROM (SELECT u.path, r.root, row_number() OVER (PARTITION BY u.path ORDER BY length(r.root) DESC) AS n FROM (SELECT DISTINCT path FROM {v.URLS}) u JOIN (SELECT DISTINCT regexp_extract(path, '^(/[^/]+)', 1) AS root FROM {v.URLS} UNION SELECT DISTINCT regexp_extract(path, '^(/[^/]+/[^/]+)', 1) FROM {v.URLS}) r ON r.root <> '' AND {v.under('u.path', 'r.root')}) WHERE n = 1 GROUP BY path")
def _(x):
    u = x.url_files().select("path").distinct()
    r = u.select(F.explode(F.array(F.regexp_extract("path", "^(/[^/]+)", 1), F.regexp_extract("path", "^(/[^/]+/[^/]+)", 1))).alias("root")).where("root <> ''").distinct()
    return paths.longest_prefix(u, r)


# --- metrics ------------------------------------------------------------------------------------------------------


@query("mt1_param_count", "SELECT l_orderkey AS ast_node_id, count(*)::DOUBLE AS value FROM lineitem GROUP BY 1")
def _(x):
    return metrics.parameter_count(x.table("lineitem").groupBy(F.col("l_orderkey").alias("ast_node_id")).agg(F.collect_list("l_partkey").alias("parameters")))


@query("mt2_function_value", "SELECT p_partkey AS ast_node_id, p_size::DOUBLE AS value FROM part")
def _(x):
    return metrics.function_mccabe(x.table("part").select(F.col("p_partkey").alias("ast_node_id"), F.col("p_size").alias("mccabe")))


@query("mt3_type_sum", "SELECT s_nationkey AS type_hash, coalesce(sum(p_size), 0)::DOUBLE AS value FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(x):
    s = x.table("supplier").select(F.col("s_nationkey").alias("type_hash"), "s_suppkey")
    m = s.join(x.table("lineitem").select("l_suppkey", "l_partkey").distinct(), F.col("l_suppkey") == F.col("s_suppkey")).join(x.table("part"), F.col("p_partkey") == F.col("l_partkey"))
    return metrics.type_sum(s.select("type_hash").distinct(), m, "type_hash", "p_size")


@query("mt4_bumpy", "SELECT o_orderkey AS ast_node_id, CASE WHEN count(l_orderkey) = 0 THEN 1.0::DOUBLE ELSE round(sum(l_linenumber)::DOUBLE / count(l_orderkey), 9) END AS value FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(x):
    g = x.table("lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("bumpiness"), F.count("*").alias("statement_count"))
    f = x.table("orders").join(g, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("ast_node_id"), F.coalesce("bumpiness", F.lit(0)).alias("bumpiness"), F.coalesce("statement_count", F.lit(0)).alias("statement_count"))
    return metrics.bumpy_road(f).select("ast_node_id", F.round("value", 9).alias("value"))


_COHESION = "(WITH m AS (SELECT c_nationkey AS type, o_orderkey AS method FROM customer JOIN orders ON o_custkey = c_custkey), u AS (SELECT DISTINCT l_orderkey AS method, p_brand AS field FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT n_nationkey AS type, (SELECT count(DISTINCT method) FROM m WHERE type = n_nationkey) AS m, (SELECT count(DISTINCT field) FROM m JOIN u USING (method) WHERE type = n_nationkey) AS f, (SELECT count(*) FROM m JOIN u USING (method) WHERE type = n_nationkey) AS c FROM nation)"


@query("mt5_cohesion", f"SELECT type, CASE WHEN f = 0 OR m = 0 THEN 0.0::DOUBLE ELSE round(1 - c::DOUBLE / (m * f), 9) END AS loc FROM {_COHESION}")
def _(x):
    return metrics.cohesion(*x.cohesion()).select("type", F.round("loc", 9).alias("loc"))


@query("mt6_cohesion_hs", f"SELECT type, CASE WHEN f = 0 OR m = 0 THEN 0.0::DOUBLE WHEN m = 1 THEN 'nan'::DOUBLE ELSE round((m - c::DOUBLE / f) / (m - 1), 9) END AS loc_hs FROM {_COHESION}")
def _(x):
    return metrics.cohesion(*x.cohesion()).select("type", F.round("loc_hs", 9).alias("loc_hs"))


@query("mt18_cohesion_slices", _SQL["mt5_cohesion"])
def _(x):
    return slices.cohesion(*x.cohesion(), 16).select("type", F.round("loc", 9).alias("loc"))


_CLASS = "CASE WHEN cost < 1 THEN 0 WHEN length(bin(cost)) < 3 THEN 4 * length(bin(cost)) ELSE 4 * length(bin(cost)) + ((cost >> (length(bin(cost)) - 3)) & 3) END"


@query("mt18_slices", f"SELECT class, CASE WHEN nth // 16 % 2 = 0 THEN nth % 16 ELSE 15 - nth % 16 END AS slice, count(*) AS n FROM (SELECT class, row_number() OVER (ORDER BY class DESC) - 1 AS nth FROM (SELECT {_CLASS} AS class FROM (SELECT CAST(sum(l_quantity) AS BIGINT) AS cost FROM lineitem GROUP BY l_orderkey))) GROUP BY ALL")
def _(x):
    cost = x.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.sum("l_quantity")).cast("long").alias("cost"))
    return slices.deal(cost, ["id"], "cost", 16).groupBy(long("class"), long("slice")).agg(F.count("*").alias("n"))


@query("mt7_efferent", f"SELECT entity, {ints('count(DISTINCT dependency)')} AS value FROM {v.TYPES} LEFT JOIN {v.DEPS} d USING (entity) GROUP BY entity")
def _(x):
    return metrics.efferent(x.types(), x.dependencies())


@query("mt8_afferent", f"SELECT t.entity, {ints('count(DISTINCT d.entity)')} AS value FROM {v.TYPES} t LEFT JOIN {v.DEPS} d ON d.dependency = t.entity GROUP BY t.entity")
def _(x):
    return metrics.afferent(x.types(), x.dependencies())


@query("mt9_module_efferent", f"SELECT dir, {ints('count(DISTINCT dependency)')} AS value FROM {v.MODULES} m LEFT JOIN {v.LOCATED} l ON {v.under('entity_path', 'dir')} AND NOT {v.under('dependency_path', 'dir')} GROUP BY dir")
def _(x):
    return metrics.module_efferent(x.modules(), metrics.located(x.dependencies(), x.types()))


@query("mt9_module_efferent_raw", f"SELECT dir, {ints('count(DISTINCT dependency)')} AS value FROM {v.MODULES} m LEFT JOIN {v.LOCATED} l ON entity_path LIKE dir || '%' AND NOT dependency_path LIKE dir || '%' GROUP BY dir")
def _(x):
    return metrics.module_efferent(x.modules(), metrics.located(x.dependencies(), x.types()), raw_prefix=True)


@query("mt10_module_afferent", f"SELECT dir, {ints('count(DISTINCT entity)')} AS value FROM {v.MODULES} m LEFT JOIN {v.LOCATED} l ON {v.under('dependency_path', 'dir')} AND NOT {v.under('entity_path', 'dir')} GROUP BY dir")
def _(x):
    return metrics.module_afferent(x.modules(), metrics.located(x.dependencies(), x.types()))


@query("mt11_relational_cohesion", f"SELECT m.dir, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round((r + 1)::DOUBLE / n, 9) END AS value FROM (SELECT dir, count(l.entity) AS r FROM {v.MODULES} m LEFT JOIN {v.LOCATED} l ON {v.under('entity_path', 'dir')} AND {v.under('dependency_path', 'dir')} GROUP BY dir) m JOIN (SELECT dir, count(t.entity) AS n FROM {v.MODULES} m LEFT JOIN {v.TYPES} t ON {v.under('t.path', 'dir')} GROUP BY dir) k USING (dir)")
def _(x):
    out = metrics.relational_cohesion(x.modules(), metrics.located(x.dependencies(), x.types()), x.types())
    return out.select("dir", F.round("value", 9).alias("value"))


@query("mt12_module_set", f"SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS dir FROM {v.FILES}, unnest(range(2, len(string_split(path, '/')))) u(i)")
def _(x):
    return metrics.module_set(x.files())


@query("mt13_scope", f"SELECT count(*) AS n FROM {v.FILES} WHERE {v.under('path', chr(39) + '/src1' + chr(39))} OR {v.under('path', chr(39) + '/src2/en' + chr(39))}")
def _(x):
    return x.files().where(metrics.in_scope("path", ["/src1", "/src2/en"])).agg(F.count("*").alias("n"))


_BARE = r"regexp_replace(array_to_string([CASE WHEN i < len(ls) AND regexp_full_match(ls[i], '[ \t\r\x0B\x0C]*') THEN '' ELSE ls[i] END FOR i IN range(1, len(ls) + 1)], chr(10)), '\n+', chr(10), 'g')"


@query("mt14_loc", f"SELECT id, type, CAST(metric AS INTEGER) AS metric FROM (SELECT id, unnest([1, 2, 3]) AS type, unnest([len(ls), n, n]) AS metric FROM (SELECT id, content, ls, CASE WHEN x = '' THEN 0 ELSE len(string_split(x, chr(10))) END AS n FROM (SELECT id, content, ls, {_BARE} AS x FROM (SELECT id, content, string_split(content, chr(10)) AS ls FROM {v.FILES}))) WHERE content <> '') WHERE metric > 0")
def _(x):
    return loc.lines_of_code(x.files())


_CHOSEN = f"(SELECT path, CASE WHEN content <> '' THEN {ints('len(string_split(content, chr(10)))')} END AS metric FROM {v.FILES} WHERE type IN ('en', 'de', 'fr'))"


@query("mt15_loc_entries", f"SELECT path, array_to_string(list_slice(string_split(path, '/'), 1, -2), '/') AS parent, false AS is_dir, metric FROM {_CHOSEN} WHERE metric > 0 UNION ALL SELECT dir, array_to_string(list_slice(string_split(dir, '/'), 1, -2), '/'), true, {ints('sum(metric)')} FROM (SELECT array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS dir, metric FROM {_CHOSEN}, unnest(range(2, len(string_split(path, '/')))) u(i) WHERE metric > 0) GROUP BY dir")
def _(x):
    return loc.loc_entries(loc.lines_of_code(x.files()), x.files(), "", ["en", "de", "fr"], loc.ORIGINAL)


@query("fn6_without_blank_lines", f"SELECT id, sha1({_BARE}) AS h FROM (SELECT id, string_split(content, chr(10)) AS ls FROM {v.FILES})")
def _(x):
    return x.files().select("id", expr.sha1(expr.without_blank_lines("content")).alias("h"))


@query("mt17_tree_rollup", f"SELECT array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS dir, {ints('sum(n_chars)')} AS n_chars, count(*) AS files FROM {v.FILES}, unnest(range(2, len(string_split(path, '/')))) u(i) GROUP BY 1")
def _(x):
    return paths.rollup(x.files(), "path", "n_chars")


# --- graph --------------------------------------------------------------------------------------------------------

_KIND = "error"
_E = f"(SELECT DISTINCT lhs, rhs FROM {v.RELATIONS} WHERE kind = '{_KIND}')"
_START = f"(SELECT min(lhs) AS start FROM {v.RELATIONS} WHERE kind = '{_KIND}')"


def _start(x) -> DataFrame:
    return x.relations(_KIND).agg(F.min("lhs").alias("start")).where("start IS NOT NULL")


@query("gr1_bfs_depth", f"WITH RECURSIVE b(node, depth) AS (SELECT rhs, 1 FROM {_E} JOIN {_START} ON lhs = start UNION SELECT e.rhs, depth + 1 FROM b JOIN {_E} e ON e.lhs = b.node WHERE depth < 3) SELECT node, min(depth) AS depth FROM b GROUP BY node")
def _(x):
    return graph.bfs(x.relations(_KIND), _start(x), 3, "lhs", "rhs").select("node", "depth")


@query("gr2_closure_fwd", f"WITH RECURSIVE b(node) AS (SELECT rhs FROM {_E} JOIN {_START} ON lhs = start UNION SELECT e.rhs FROM b JOIN {_E} e ON e.lhs = b.node) SELECT node FROM b")
def _(x):
    return graph.closure(x.relations(_KIND), _start(x), False, "lhs", "rhs").select("node")


@query("gr2_closure_rev", f"WITH RECURSIVE b(node) AS (SELECT lhs FROM {_E} JOIN {_START} ON rhs = start UNION SELECT e.lhs FROM b JOIN {_E} e ON e.rhs = b.node) SELECT node FROM b")
def _(x):
    return graph.closure(x.relations(_KIND), _start(x), True, "lhs", "rhs").select("node")


@query("gr3_impact", f"WITH RECURSIVE b(file_id) AS (SELECT start FROM {_START} UNION SELECT e.lhs FROM b JOIN {_E} e ON e.rhs = b.file_id) SELECT file_id FROM b")
def _(x):
    e = x.relations(_KIND).select(F.col("lhs").alias("includer"), F.col("rhs").alias("included"))
    return graph.impact(e, _start(x).withColumnRenamed("start", "file_id"))


_UPWARD = f"(SELECT DISTINCT least(lhs, rhs) AS lhs, greatest(lhs, rhs) AS rhs FROM {v.RELATIONS} WHERE kind = '{_KIND}' AND lhs <> rhs)"


@query("gr4_topo_levels", f"WITH RECURSIVE l(id, d) AS (SELECT lhs, 0 FROM {_UPWARD} UNION SELECT rhs, 0 FROM {_UPWARD} UNION SELECT e.rhs, d + 1 FROM l JOIN {_UPWARD} e ON e.lhs = l.id) SELECT id, CAST(max(d) AS INTEGER) AS level FROM l GROUP BY id")
def _(x):
    e = x.relations(_KIND).where("lhs <> rhs").select(F.least("lhs", "rhs").alias("lhs"), F.greatest("lhs", "rhs").alias("rhs"))
    n = e.select(F.col("lhs").alias("id")).unionByName(e.select(F.col("rhs").alias("id"))).distinct()
    return graph.topological_levels(n, e, "id", "lhs", "rhs")


@query("gr4_topo_cycles")
def _(x):
    e = x.relations(_KIND)
    n = e.select(F.col("lhs").alias("id")).unionByName(e.select(F.col("rhs").alias("id"))).distinct()
    return graph.topological_levels(n, e, "id", "lhs", "rhs")


@query("gr5_subtree", f"SELECT path, is_dir FROM {v.TREE} WHERE {v.under('path', chr(39) + '/ASIA' + chr(39))}")
def _(x):
    return paths.subtree(x.tree(), "/ASIA")


@query("gr6_ancestors", f"SELECT path, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS dir FROM {v.FILES}, unnest(range(2, len(string_split(path, '/')))) u(i)")
def _(x):
    return paths.with_ancestors(x.files().select("path"), "path")


@query("gr7_children", f"SELECT path, is_dir FROM {v.TREE} WHERE regexp_matches(path, '^/EUROPE/[^/]*$')")
def _(x):
    return paths.children(x.tree(), "/EUROPE")


@query("gr8_neighbours", f"SELECT DISTINCT lhs AS start, rhs AS node FROM {v.RELATIONS} WHERE kind IN ('view', '{_KIND}')")
def _(x):
    e = x.relations().select(F.col("lhs").alias("src"), F.col("rhs").alias("dst"), F.col("kind").alias("type"))
    starts = e.select(F.col("src").alias("start"))
    return graph.neighbours(e, starts, _KIND).unionByName(graph.neighbours(e, starts, "view")).distinct()


_DIR_EDGES = f"(SELECT DISTINCT a.dir AS src_dir, b.dir AS dst_dir FROM {v.EDGES} e JOIN {v.DIRS} a ON a.file = e.src JOIN {v.DIRS} b ON b.file = e.dst WHERE a.dir <> b.dir)"


def _dir_edges(x) -> DataFrame:
    return graph.lifted(x.file_edges(), x.file_dirs())


@query("gr13_dir_depends", f"SELECT * FROM {_DIR_EDGES}")
def _(x):
    return _dir_edges(x)


_PROVIDES = _DIR_EDGES.replace(v.EDGES, "(SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R')")


@query("gr14_dir_implements", f"SELECT * FROM {_PROVIDES}")
def _(x):
    provides = x.table("lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return graph.lifted(provides, x.file_dirs())


@query("gr17_external_deps", f"SELECT src_dir, dst_dir FROM {_DIR_EDGES} WHERE starts_with(src_dir, '/ASIA/') AND NOT starts_with(dst_dir, '/ASIA/')")
def _(x):
    return graph.external(_dir_edges(x), "/ASIA")


_PART_DIRS = f"(SELECT DISTINCT '/' || a.p_brand || '/' || a.p_type AS src_dir, '/' || b.p_brand || '/' || b.p_type AS dst_dir FROM {v.DEPS} d JOIN part a ON a.p_partkey = entity JOIN part b ON b.p_partkey = dependency WHERE a.p_type < b.p_type)"


@query("gr18_external_users", f"WITH RECURSIVE e AS (SELECT * FROM {_PART_DIRS} WHERE src_dir <> dst_dir), b(node) AS (SELECT dst_dir FROM e WHERE starts_with(dst_dir, '/Brand#1/') UNION SELECT e.src_dir FROM b JOIN e ON e.dst_dir = b.node) SELECT node FROM b WHERE NOT starts_with(node, '/Brand#1/')")
def _(x):
    f = x.types().select(F.col("entity").alias("file"), expr.parent("path").alias("dir"), F.split("path", "/")[2].alias("type"))
    # upward in type, so that not every directory reaches every other
    d = x.dependencies().join(f.select(F.col("file").alias("entity"), F.col("type").alias("a")), "entity").join(f.select(F.col("file").alias("dependency"), F.col("type").alias("b")), "dependency").where("a < b")
    return graph.external_users(graph.lifted(d, f.select("file", "dir"), "entity", "dependency"), "/Brand#1")


@query("gr20_internal_deps", f"WITH e AS (SELECT DISTINCT '/' || a.p_brand || '/' || a.p_type AS src_dir, '/' || b.p_brand || '/' || b.p_type AS dst_dir FROM {v.DEPS} d JOIN part a ON a.p_partkey = entity JOIN part b ON b.p_partkey = dependency) SELECT * FROM e WHERE src_dir <> dst_dir AND {v.under('src_dir', chr(39) + '/Brand#1' + chr(39))} AND {v.under('dst_dir', chr(39) + '/Brand#1' + chr(39))}")
def _(x):
    f = x.types().select(F.col("entity").alias("file"), expr.parent("path").alias("dir"))
    return graph.internal(graph.lifted(x.dependencies(), f, "entity", "dependency"), "/Brand#1")


@query("gr23_merge_edges", "SELECT c_nationkey AS src, s_nationkey AS dst, string_agg(c_mktsegment, ', ' ORDER BY c_mktsegment) AS label FROM (SELECT DISTINCT c_nationkey, s_nationkey, c_mktsegment FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey) GROUP BY 1, 2")
def _(x):
    o, li = x.table("orders").select("o_orderkey", "o_custkey"), x.table("lineitem").select("l_orderkey", "l_suppkey")
    y = x.table("customer").join(o, F.col("o_custkey") == F.col("c_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(x.table("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return graph.merged_edges(y.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), "c_mktsegment").distinct(), "c_mktsegment")


#: Files are suppliers (by key) and parts (1000000 + key): suppliers use parts, a part provides the part of half its number.
_FILE_EDGES = "(SELECT DISTINCT l_suppkey AS src, 1000000 + l_partkey AS dst, 'USE' AS type FROM lineitem UNION ALL SELECT 1000000 + p_partkey, 1000000 + p_partkey // 2, 'PROVIDE' FROM part WHERE p_partkey >= 2)"
_HELD = "(SELECT DISTINCT 2000000 + s_nationkey AS t, s_suppkey AS f FROM supplier)"


def _file_edges(x) -> DataFrame:
    use = x.table("lineitem").select(F.col("l_suppkey").alias("src"), (1_000_000 + F.col("l_partkey")).alias("dst"), F.lit("USE").alias("type")).distinct()
    key = F.col("p_partkey")
    return use.unionByName(x.table("part").where("p_partkey >= 2").select((1_000_000 + key).alias("src"), (1_000_000 + F.floor(key / 2)).alias("dst"), F.lit("PROVIDE").alias("type")))


@query("gr9_use", f"SELECT dst AS start, src AS node FROM {_FILE_EDGES} WHERE type = 'USE'")
def _(x):
    e = _file_edges(x)
    return graph.neighbours(e, e.select(F.col("dst").alias("start")), "USE", True)


@query("gr10_provide", f"SELECT src AS start, dst AS node FROM {_FILE_EDGES} WHERE type = 'PROVIDE'")
def _(x):
    e = _file_edges(x)
    return graph.neighbours(e, e.select(F.col("src").alias("start")), "PROVIDE")


@query("gr11_contains", f"SELECT DISTINCT f AS start, t AS node FROM {_HELD}")
def _(x):
    s = x.table("supplier")
    targets = s.select((2_000_000 + F.col("s_nationkey")).alias("file_id"), F.col("s_nationkey").alias("action_id")).distinct()
    sources = s.select(F.col("s_suppkey").alias("file_id"), F.col("s_nationkey").alias("action_id"))
    return graph.build_targets(targets, sources, sources.select("file_id").distinct())


@query("gr15_component_users", f"WITH RECURSIVE h AS (SELECT 1000020 AS node UNION SELECT dst FROM {_FILE_EDGES} WHERE src = 1000020 AND type = 'PROVIDE'), u(node) AS (SELECT node FROM h UNION SELECT e.src FROM u JOIN {_FILE_EDGES} e ON e.dst = u.node AND e.type = 'USE') SELECT src, dst, type FROM {_FILE_EDGES} WHERE src = 1000020 AND type = 'PROVIDE' UNION SELECT src, dst, type FROM {_FILE_EDGES} WHERE type = 'USE' AND dst IN (SELECT node FROM u) UNION SELECT t, f, 'CONTAINS' FROM {_HELD} WHERE f IN (SELECT node FROM u)")
def _(x):
    s = x.table("supplier")
    targets = s.select((2_000_000 + F.col("s_nationkey")).alias("file_id"), F.col("s_nationkey").alias("action_id")).distinct()
    sources = s.select(F.col("s_suppkey").alias("file_id"), F.col("s_nationkey").alias("action_id"))
    return graph.component_users(_file_edges(x), targets, sources, 1_000_020)


def _walk(kind: str, a: str, b: str) -> str:
    near = f"(WITH RECURSIVE n(node, d) AS (SELECT 1000020, 0 UNION SELECT e.{b}, d + 1 FROM n JOIN {_FILE_EDGES} e ON e.{a} = n.node AND e.type = '{kind}' WHERE d < 2) SELECT node FROM n)"
    return f"SELECT src, dst, type FROM {_FILE_EDGES} WHERE type = '{kind}' AND {a} IN {near}"


@query("gr16_include_dependency", " UNION ".join(_walk(k, a, b) for k in ("USE", "PROVIDE") for a, b in (("src", "dst"), ("dst", "src"))))
def _(x):
    return graph.include_dependency(_file_edges(x), 1_000_020)


@query("gr19_interface", f"SELECT src, dst, type FROM {_FILE_EDGES} WHERE src = 1000020 OR dst = 1000020 UNION SELECT o_custkey, 1000020, 'INCLUDE' FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(x):
    inc = x.table("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("includer"), F.lit(1_000_020).cast("long").alias("included"))
    return graph.interface(_file_edges(x), inc, 1_000_020)


# --- search -------------------------------------------------------------------------------------------------------


_BUILT: dict[tuple[str, str], str] = {}


def _index(x) -> index.Index:
    """The search index of the documents in the shared folder: built by the first query of an application that asks for
    it, read by all."""
    key = x.spark.sparkContext.applicationId, x.dir
    if key not in _BUILT:
        d = x.table("documents")
        docs = d.select("doc_id", F.col("text").alias("content"), F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("dir"), F.concat(F.lit("text/"), "lang").alias("mime"))
        folder = f"{store.folder(x.spark)}/index-{uuid.uuid4().hex}"
        index.build(docs, folder)
        _BUILT[key] = folder
    return index.Index(x.spark, _BUILT[key])


@query("sr1_or", f"SELECT doc_id, count(DISTINCT term) AS terms, count(*) AS hits FROM {v.POSTINGS} WHERE term IN ('with', 'from', 'nicht') GROUP BY doc_id")
def _(x):
    return search.any_of(search.postings(x.table("documents")), ["with", "from", "nicht"])


@query("sr2_and_not", f"SELECT doc_id FROM {v.POSTINGS} GROUP BY doc_id HAVING bool_or(term = 'the') AND bool_or(term = 'with') AND NOT bool_or(term = 'from')")
def _(x):
    return _index(x).boolean(["the", "with"], ["from"])


@query("sr3_phrase", f"SELECT doc_id, position FROM (SELECT *, lead(term) OVER (PARTITION BY doc_id ORDER BY position) AS following FROM {v.POSTINGS}) WHERE term = 'of' AND following = 'the'")
def _(x):
    return _index(x).phrase(["of", "the"]).select("doc_id", long("position"))


@query("sr4_wildcard", f"SELECT doc_id, count(*) AS hits FROM {v.POSTINGS} WHERE term LIKE '%tion_n%' GROUP BY doc_id")
def _(x):
    ix = _index(x)
    return ix.hits(ix.wildcard_terms("*tion?n*"))


@query("sr5_regex", f"SELECT doc_id, count(*) AS hits FROM {v.POSTINGS} WHERE regexp_full_match(term, 'th(e|is|at)') GROUP BY doc_id")
def _(x):
    ix = _index(x)
    return ix.hits(ix.regex_terms("th(e|is|at)"))


@query("sr5_fuzzy", f"SELECT doc_id, count(*) AS hits FROM {v.POSTINGS} WHERE levenshtein(term, 'from') <= 1 GROUP BY doc_id")
def _(x):
    ix = _index(x)
    return ix.hits(ix.fuzzy_terms("from", 1))


@query("sr5_range", f"SELECT doc_id, count(*) AS hits FROM {v.POSTINGS} WHERE term BETWEEN 'w' AND 'wi' GROUP BY doc_id")
def _(x):
    ix = _index(x)
    return ix.hits(ix.range_terms("w", "wi"))


@query("sr5_prefix", f"SELECT doc_id, count(*) AS hits FROM {v.POSTINGS} WHERE starts_with(term, 'ing') GROUP BY doc_id")
def _(x):
    ix = _index(x)
    return ix.hits(ix.prefix_terms("ing"))


@query("sr6_definitions", "SELECT p_partkey AS doc_id, p_type AS kind FROM part WHERE lower(p_brand) = 'brand#7' AND p_type LIKE '%A%'")
def _(x):
    t = x.table("part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("kind"))
    return search.definitions(t, "Brand#7").where("kind LIKE '%A%'").select("doc_id", "kind")


@query("sr6_by_kind", "WITH t AS (SELECT p_partkey AS tag, p_size AS doc_id, lower(p_brand) AS name, p_type AS kind FROM part), k AS (SELECT min(kind) AS a, max(kind) AS b FROM t) SELECT tag, doc_id FROM t, k WHERE kind IN (a, b) AND (name LIKE 'brand#1%' OR name LIKE '%#_2') AND doc_id IN (SELECT doc_id FROM t, k WHERE name LIKE 'brand#1%' AND kind = a OR name LIKE '%#_2' AND kind = b)")
def _(x):
    t = x.table("part").select(F.col("p_partkey").alias("tag"), F.col("p_size").alias("doc_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("kind"))
    a, b = t.agg(F.min("kind"), F.max("kind")).first()
    return search.definition_search(t, [(a, "Brand#1*"), (b, "*#?2")]).select("tag", "doc_id")


_NEXT = f"(SELECT *, min(CASE WHEN term = 'from' THEN position END) OVER w AS f, min(CASE WHEN term = 'with' THEN position END) OVER w AS u FROM {v.POSTINGS} WHERE term IN ('with', 'from') WINDOW w AS (PARTITION BY doc_id ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"
#: Of two terms each place matches the other's next one, if it is near enough.
_MATCHES = f"(SELECT doc_id, position AS first, n AS last, 3 - (n - position - step) * (n - position - step) / 441.0::DOUBLE AS score FROM (SELECT doc_id, position, CASE WHEN term = 'with' THEN f ELSE u END AS n, CASE WHEN term = 'with' THEN 1 ELSE -1 END AS step FROM {_NEXT}) WHERE n - position <= 20)"


@query("sr8_proximity", f"SELECT doc_id, first, last, round(score, 9) AS score FROM {_MATCHES}")
def _(x):
    return _index(x).proximity_all(["with", "from"]).select("doc_id", long("first"), long("last"), F.round("score", 9).alias("score"))


@query("sr8_best_of_three")
def _(x):
    return _index(x).proximity(["with", "from", "this"])


#: Places of terms: line and column from 1, of their beginning and their end.
_AT = f"(SELECT o.doc_id, position, o.start, stop, line, o.start - l.start + 1 AS col FROM {v.OFFSETS} o ASOF JOIN {v.LINES} l ON o.doc_id = l.doc_id AND o.start >= l.start)"


@query("sr20_log_spans", f"SELECT doc_id, first, last, a.line AS first_line, a.col AS first_col, b.line AS last_line, b.col + b.stop - b.start AS last_col FROM (SELECT *, lead(last) OVER (PARTITION BY doc_id ORDER BY first, last) AS e FROM {_MATCHES}) m JOIN {_AT} a USING (doc_id) JOIN {_AT} b USING (doc_id) WHERE (e IS NULL OR e > last) AND a.position = first AND b.position = last")
def _(x):
    return _index(x).log_search("with, from:").select("doc_id", *map(long, ("first", "last", "first_line", "first_col", "last_line", "last_col")))


@query("sr7_log_terms", f"SELECT doc_id, count(*) AS n FROM {_MATCHES} GROUP BY doc_id")
def _(x):
    return _index(x).proximity_all(search.log_query("With -- from!")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("src16_index", f"SELECT doc_id, count(DISTINCT term) AS terms, count(*) AS hits FROM {v.POSTINGS} WHERE term IN ('with', 'from', 'nicht') GROUP BY doc_id")
def _(x):
    return _index(x).any_of(["with", "from", "nicht"])


@query("src16_fields", f"SELECT field, term, count(*) AS n FROM (SELECT 'dir' AS field, unnest([source, lang]) AS term FROM documents UNION ALL SELECT 'mime', 'text/' || lang FROM documents UNION ALL SELECT 'name', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id IS NOT NULL) WHERE term IS NOT NULL GROUP BY field, term")
def _(x):
    ix = _index(x)
    p = functools.reduce(DataFrame.unionByName, (ix.of(f).select(F.lit(f).alias("field"), "term") for f in ("dir", "mime", "name")))
    return p.groupBy("field", "term").agg(F.count("*").alias("n"))


def _runs(terms: str, more: str = "") -> str:
    return f"SELECT doc_id, line, {ints('min(col)')} AS start_col, {ints('max(col + stop - start)')} AS end_col, count(*) AS tokens FROM (SELECT *, position - row_number() OVER (PARTITION BY doc_id ORDER BY position) AS g FROM (SELECT o.doc_id, position, term, o.start, stop, line, o.start - l.start + 1 AS col FROM {v.OFFSETS} o ASOF JOIN {v.LINES} l ON o.doc_id = l.doc_id AND o.start >= l.start) WHERE {terms}{more}) GROUP BY doc_id, line, g"


@query("sr10_indexed", _runs("regexp_full_match(term, 'th(e|is|at)')"))
def _(x):
    ix = _index(x)
    return ix.line_matches(ix.regex_terms("th(e|is|at)")).select("doc_id", *map(long, ("line", "start_col", "end_col", "tokens")))


_TFIDF = "(SELECT doc_id, sum(sqrt(tf) * (1 + ln(n / (df + 1)))) AS score FROM (SELECT doc_id, term, count(*) AS tf, count(*) OVER (PARTITION BY term) AS df FROM {posts} WHERE term IN ('with', 'from') GROUP BY doc_id, term), (SELECT count(*)::DOUBLE AS n FROM documents) GROUP BY doc_id)".format(posts=v.POSTINGS)


@query("sr19_relevance", f"SELECT doc_id, round(score, 6) AS score FROM {_TFIDF}")
def _(x):
    d = x.table("documents")
    return search.relevance(_index(x).of("content", "with", "from"), ["with", "from"], d.count()).select("doc_id", F.round("score", 6).alias("score"))


@query("sr13_boost", f"SELECT doc_id, round(score * (1 + CASE WHEN lang = 'en' THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END), 6) AS score FROM {_TFIDF} JOIN documents USING (doc_id)")
def _(x):
    d = x.table("documents")
    f = d.select("doc_id", F.when(F.col("lang") == "en", "a.cc").otherwise("a.txt").alias("path"), (F.col("doc_id") % 3 == 0).alias("parsed"))
    return search.boosted(search.relevance(_index(x).of("content", "with", "from"), ["with", "from"], d.count()), f).select("doc_id", F.round("score", 6).alias("score"))


@query("fn10_path_tokens", f"SELECT page_id, array_to_string([p FOR p IN string_split(path, '/') IF p <> ''], ' ') AS tokens FROM {v.URLS}")
def _(x):
    return x.url_files().select("page_id", F.array_join(expr.path_tokens("path"), " ").alias("tokens"))


@query("snk2_connection", "SELECT c_custkey, 'pgsql:host=' || c_mktsegment || ';port=' || c_nationkey AS conn FROM customer")
def _(x):
    t = F.concat(F.lit("pgsql:port=1;host="), F.col("c_mktsegment"))
    return x.table("customer").select("c_custkey", expr.connection_with(t, "port", F.col("c_nationkey").cast("string")).alias("conn"))


@query("sr9_overlap", f"WITH m AS (SELECT doc_id, position AS first, position + 3 + (position % 3) AS last FROM {v.POSTINGS} WHERE term = 'with'), n AS (SELECT *, lead(last) OVER (PARTITION BY doc_id ORDER BY first, last) AS e FROM m) SELECT doc_id, first, last FROM n WHERE e IS NULL OR e > last")
def _(x):
    m = _index(x).of("content", "with").select("doc_id", F.col("position").alias("first"), (F.col("position") + 3 + F.col("position") % 3).alias("last"))
    return search.without_overlaps(m).select("doc_id", long("first"), long("last"))


@query("sr10_line_matches", _runs("term IN ('of', 'the')", f" AND start < {index.ANALYSED}"))
def _(x):
    return _index(x).line_matches(["of", "the"], index.ANALYSED).select("doc_id", *map(long, ("line", "start_col", "end_col", "tokens")))


@query("sr12_near_best", "SELECT o_custkey AS doc_id, o_orderkey, o_totalprice AS score FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS b FROM orders) WHERE o_totalprice >= b - 1000")
def _(x):
    return search.near_best(x.table("orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.col("o_totalprice").alias("score")), 1000.0)


@query("sr15_file_regex", f"SELECT id, path FROM {v.FILES} WHERE regexp_matches(filename, '(?i)7.$')")
def _(x):
    return search.files_by_regex(x.files().select("id", "path"), "7.$")


@query("sr16_file_substring", f"SELECT id, path FROM {v.FILES} WHERE contains(lower(path), 'rc1/d')")
def _(x):
    return search.files_by_substring(x.files().select("id", "path"), "RC1/D")


@query("sr17_suggest", f"SELECT name, distance FROM (SELECT name, levenshtein(substr(name, 1, 4), 'thri') AS distance FROM (SELECT DISTINCT term AS name FROM {v.POSTINGS})) WHERE distance <= 1 ORDER BY distance, name LIMIT 5")
def _(x):
    return _index(x).suggest("thri", field="content").select("name", F.col("distance").cast("long").alias("distance"))


# --- history and maintenance --------------------------------------------------------------------------------------


@query("hs1_log_filter", f"SELECT oid, time FROM {v.COMMITS} WHERE contains(lower(message), 'purch') OR contains(author, '77')")
def _(x):
    return history.matching(x.commits(), "purch").select("oid", "time").unionByName(history.matching(x.commits().select("oid", "time", "author"), "77").select("oid", "time")).distinct()


@query("hs1_log_page", f"SELECT oid, time FROM {v.COMMITS} ORDER BY time DESC, oid LIMIT 25 OFFSET 50")
def _(x):
    return history.log(x.commits(), 25, 50).select("oid", "time")


@query("hs2_parents", f"SELECT a.oid, b.oid AS parent, b.time FROM {v.COMMITS} a JOIN {v.COMMITS} b ON a.parent = b.oid")
def _(x):
    c = x.commits()
    return c.select("oid", "parent").join(c.select(F.col("oid").alias("parent"), "time"), "parent").select("oid", "parent", "time")


@query("hs3_refs", "SELECT kind, ref FROM (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'tag' ELSE 'local' END AS kind, CASE n_nationkey % 3 WHEN 0 THEN 'refs/remotes/' WHEN 1 THEN 'refs/tags/' ELSE 'refs/heads/' END || n_name AS ref, n_nationkey FROM nation) WHERE kind <> 'local' OR n_nationkey = 2")
def _(x):
    k = F.col("n_nationkey") % 3
    r = x.table("nation").select(F.when(k == 0, "remote").when(k == 1, "tag").otherwise("local").alias("kind"), F.col("n_name").alias("name"), (F.col("n_nationkey") == 2).alias("is_head"))
    return history.reference_names(r)


@query("hs6_blame_hunks", "WITH t AS (SELECT conv_id, turn, role, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS nw FROM conversations), g AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM t) SELECT conv_id, role, min(turn) AS first_line, count(*) AS n_lines FROM g GROUP BY conv_id, h, role")
def _(x):
    return history.blame_hunks(x.table("conversations"), "conv_id", "turn", "role")


@query("hs4_reference_top", "SELECT CAST(n_regionkey AS VARCHAR) AS oid, r_name AS type FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 7")
def _(x):
    n = x.table("nation").select(F.col("n_nationkey").alias("name"), F.col("n_regionkey").cast("string").alias("oid"))
    return history.reference_top(n, x.table("region").select(F.col("r_regionkey").cast("string").alias("oid"), F.col("r_name").alias("type")), 7)


_CHANGED = f"(SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'A' WHEN b.path IS NULL THEN 'D' ELSE 'M' END AS status FROM (SELECT path, content FROM {v.FILES} WHERE n_chars < 4000) a FULL JOIN (SELECT path, CASE WHEN type = 'de' THEN content || chr(10) ELSE content END AS content FROM {v.FILES} WHERE n_chars > 300) b ON a.path = b.path WHERE a.content IS DISTINCT FROM b.content)"


def _trees(x) -> tuple[DataFrame, DataFrame]:
    f = x.files()
    return f.where("n_chars < 4000").select("path", "content"), f.where("n_chars > 300").select("path", F.when(F.col("type") == "de", F.concat("content", F.lit("\n"))).otherwise(F.col("content")).alias("content"))


@query("hs5_diff_names", f"SELECT path, status FROM {_CHANGED}")
def _(x):
    return history.diff_table(*_trees(x), compact=True)


@query("hs5_diff_pathspec", f"SELECT path, status FROM {_CHANGED} WHERE path LIKE '/src1/%'")
def _(x):
    return history.diff_table(*_trees(x), pathspec="/src1/*", compact=True)


@query("hs5_diff")
def _(x):
    return history.diff_table(*_trees(x))


@query("hs7_blob", "SELECT p_partkey AS blob_oid FROM part WHERE p_brand = 'Brand#7' AND p_name = (SELECT min(p_name) FROM part WHERE p_brand = 'Brand#7')")
def _(x):
    p = x.table("part").select(F.col("p_brand").alias("commit_oid"), F.col("p_name").alias("path"), F.col("p_partkey").alias("blob_oid"))
    first = p.where("commit_oid = 'Brand#7'").agg(F.min("path")).first()[0]
    return history.blob_id(p, "Brand#7", first)


@query("hs7_repositories", "SELECT s_suppkey AS id, s_name AS path, CASE WHEN s_acctbal > 0 THEN s_nationkey END AS head, s_acctbal > 0 AS available FROM supplier")
def _(x):
    s = x.table("supplier")
    return history.repository_list(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("path"), F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).alias("head")))


@query("in1_change_detect", f"SELECT path, CASE WHEN id % 10 = 0 THEN 'DELETED' ELSE 'MODIFIED' END AS status FROM {v.FILES} WHERE id % 10 = 0 OR id % 7 = 3")
def _(x):
    f = x.files().select("path", "hash", "id", "content")
    new = f.where("id % 10 <> 0").select("path", F.when(F.col("id") % 7 == 3, F.sha1(F.concat("content", F.lit("!")))).otherwise(F.col("hash")).alias("hash"))
    return maintenance.changes(f.select("path", "hash"), new)


_HARD = f"(SELECT DISTINCT user_id AS file_id FROM events WHERE event_type = '{_KIND}' AND value >= 99)"


@query("in2_dependents", f"WITH RECURSIVE b(file_id) AS (SELECT file_id FROM {_HARD} UNION SELECT e.lhs FROM b JOIN {_E} e ON e.rhs = b.file_id) SELECT file_id FROM b")
def _(x):
    e = x.relations(_KIND).select(F.col("lhs").alias("includer"), F.col("rhs").alias("included"))
    return maintenance.dependents(e, x.table("events").where((F.col("event_type") == _KIND) & (F.col("value") >= 99)).select(F.col("user_id").alias("file_id")))


@query("in4_cleanup", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def _(x):
    gone = x.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return maintenance.cleaned(x.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), gone, "l_orderkey")


@query("in6_orphan_content", f"SELECT DISTINCT hash FROM {v.FILES} WHERE hash NOT IN (SELECT hash FROM {v.FILES} WHERE id % 2 = 0)")
def _(x):
    f = x.files().select("id", "hash")
    return maintenance.orphan_contents(f.select("hash").distinct(), f.where("id % 2 = 0"), used="hash")


@query("src14_merge", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def _(x):
    old = x.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return maintenance.merged(old, old.where("id % 5 = 0").select("id", F.lit("new").alias("status")))


# --- order, pages, sets, functions --------------------------------------------------------------------------------


@query("so1_value_sort", "SELECT p_name, p_partkey FROM part ORDER BY p_name, p_partkey")
def _(x):
    return x.table("part").select("p_name", "p_partkey").orderBy("p_name", "p_partkey")


@query("so3_dir_order", f"SELECT path, is_dir FROM {v.TREE} WHERE length(path) - length(replace(path, '/', '')) <= 2")
def _(x):
    return paths.listing(x.tree().where("length(path) - length(replace(path, '/', '')) <= 2"))


#: Parts are nodes of files, one for each brand and type; the files' numbers are of their paths.
_PART_FILES = "(SELECT row_number() OVER (ORDER BY path) AS id, path FROM (SELECT DISTINCT '/' || p_brand || '/' || p_type AS path FROM part))"
_PART_NODES = f"(SELECT p_partkey AS id, f.id AS file_id, p_name AS ast_value, CAST(p_size AS INTEGER) AS start_line, f.path FROM part JOIN {_PART_FILES} f ON f.path = '/' || p_brand || '/' || p_type)"


def _part_nodes(x: Views) -> tuple[DataFrame, DataFrame]:
    path = F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type")
    p = x.table("part").withColumn("path", path)
    named = p.select("path").distinct()  # brands times types
    f = named.select(F.row_number().over(Window.orderBy("path")).cast("long").alias("id"), "path")
    line = F.col("p_size").cast("int")
    n = p.join(f.withColumnRenamed("id", "file_id"), "path").select(F.col("p_partkey").alias("id"), "file_id", F.col("p_name").alias("ast_value"), F.lit("Type").alias("symbol_type"), F.lit("Definition").alias("ast_type"), line.alias("start_line"), (line + 9).alias("end_line"))
    return n, f


_ONE = f"(SELECT id, type, min(value) AS value FROM {v.METRICS} GROUP BY id, type)"
_DETAILS = f"SELECT n.id AS ast_node_id, n.path[:length(n.path) - length(string_split(n.path, '/')[-1])] AS path, string_split(n.path, '/')[-1] AS file, n.ast_value, {ints('n.start_line + 9')} AS end_line, (SELECT min(value) FROM {_ONE} m WHERE m.id = n.id AND type = 1) AS quantity, (SELECT min(value) FROM {_ONE} m WHERE m.id = n.id AND type = 3) AS discount FROM {_PART_NODES} n WHERE n.id IN (SELECT id FROM {v.METRICS})"


def _details(x: Views, size: int | None = None, previous: int | None = None) -> DataFrame:
    n, f = _part_nodes(x)
    d = metrics.node_details(x.metrics().withColumnRenamed("id", "ast_node_id"), n, f, "", size, previous, raw_prefix=True)
    return d.select("ast_node_id", "path", "file", "ast_value", long("end_line"), F.col("metrics")[1].alias("quantity"), F.col("metrics")[3].alias("discount"))


@query("mt16_details", _DETAILS)
def _(x):
    return _details(x)


@query("mt16_details_page", f"{_DETAILS} AND n.id > 100 ORDER BY n.id LIMIT 25")
def _(x):
    return _details(x, 25, 100)


@query("mt16_node_entries", f"SELECT n.id AS ast_node_id, path, string_agg(type, ',' ORDER BY type, value) AS types, count(*) AS n FROM {_PART_NODES} n JOIN {v.METRICS} m USING (id) GROUP BY n.id, path")
def _(x):
    n, f = _part_nodes(x)
    e = metrics.node_entries(x.metrics().withColumnRenamed("id", "ast_node_id"), n, f, "", raw_prefix=True)
    return e.select("ast_node_id", F.col("metrics")[0]["path"].alias("path"), F.array_join(F.transform("metrics", lambda m: m["type"].cast("string")), ",").alias("types"), F.size("metrics").cast("long").alias("n"))


@query("mt16_module_entries", f"SELECT f.id AS file_id, f.path, count(DISTINCT p_partkey) AS parts, sum(p_size) AS size FROM {_PART_FILES} f JOIN part ON f.path = '/' || p_brand || '/' || p_type WHERE f.id IN (SELECT id FROM {_PART_FILES} WHERE id > 3 ORDER BY id LIMIT 40) GROUP BY f.id, f.path")
def _(x):
    _, f = _part_nodes(x)
    own = x.table("part").select(F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type").alias("path"), "p_size").groupBy("path").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("size"))
    m = own.join(f, "path").select(F.col("id").alias("file_id"), F.explode(F.create_map(F.lit(1), "n", F.lit(2), "size")).alias("type", "value"))
    e = metrics.module_entries(m, f, "", 40, 3, raw_prefix=True)
    return e.select("file_id", F.col("metrics")[0]["path"].alias("path"), F.col("metrics")[0]["value"].alias("parts"), F.col("metrics")[1]["value"].alias("size"))


@query("so5_page", f"SELECT DISTINCT id FROM {v.METRICS} WHERE id > 100 ORDER BY id LIMIT 20")
def _(x):
    return metrics.page(x.metrics(), "id", 20, 100)


@query("so6_page_rows", f"SELECT id, type, value FROM {v.METRICS} WHERE id IN (SELECT DISTINCT id FROM {v.METRICS} WHERE id > 100 ORDER BY id LIMIT 20)")
def _(x):
    return metrics.page_rows(x.metrics(), x.metrics(), "id", 20, 100)


@query("so7_top", "SELECT o_orderkey AS doc_id, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 10")
def _(x):
    return search.top(x.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score")), 10, 50)


@query("so8_dir_page", f"SELECT id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM {v.FILES} WHERE regexp_extract(path, '^(.*)/[^/]*$', 1) IN (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM {v.FILES} ORDER BY d LIMIT 4 OFFSET 3)")
def _(x):
    return search.directory_page(x.files().select("id", "path"), 3, 4).select("id", "dir")


_A, _B = "(SELECT l_partkey AS id FROM lineitem WHERE l_quantity >= 45)", "(SELECT l_partkey AS id FROM lineitem WHERE l_discount >= 0.09)"


def _sets(x) -> tuple[DataFrame, DataFrame]:
    li = x.table("lineitem")
    return li.where("l_quantity >= 45").select(F.col("l_partkey").alias("id")), li.where("l_discount >= 0.09").select(F.col("l_partkey").alias("id"))


@query("st1_union", f"SELECT id FROM {_A} UNION ALL SELECT id FROM {_B}")
def _(x):
    a, b = _sets(x)
    return a.unionByName(b)


@query("st2_union_distinct", f"SELECT id FROM {_A} UNION SELECT id FROM {_B}")
def _(x):
    a, b = _sets(x)
    return a.unionByName(b).dropDuplicates(["id"])


@query("st3_intersect", f"SELECT id FROM {_A} INTERSECT SELECT id FROM {_B}")
def _(x):
    a, b = _sets(x)
    return a.distinct().join(b, "id", "left_semi")


@query("st3_difference", f"SELECT id FROM {_A} EXCEPT SELECT id FROM {_B}")
def _(x):
    a, b = _sets(x)
    return a.distinct().join(b, "id", "left_anti")


@query("st4_changed_actions", "SELECT o_orderkey, o_orderpriority AS command FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def _(x):
    o = x.table("orders").select("o_orderkey", F.col("o_orderpriority").alias("command"))
    return maintenance.changed_actions(o, x.spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "command string")).select("o_orderkey", "command")


@query("prd3_prefix", f"SELECT id FROM {v.FILES} WHERE {v.under('path', chr(39) + '/src1' + chr(39))}")
def _(x):
    return x.files().where(expr.under("path", F.lit("/src1"))).select("id")


@query("prd5_regex", f"SELECT id FROM {v.FILES} WHERE regexp_matches(path, '(?i)SRC1./(DE|FR)/')")
def _(x):
    return x.files().where(expr.matches_ignore_case("path", "SRC1./(DE|FR)/")).select("id")


@query("prd6_flags", "SELECT o_orderkey FROM orders WHERE (o_orderkey & 5) <> 0")
def _(x):
    return x.table("orders").where(expr.has_flag("o_orderkey", 5)).select("o_orderkey")


@query("prd13_last_parts", f"SELECT id, '.../' || array_to_string(list_slice(string_split(path, '/'), -2, -1), '/') AS label FROM {v.FILES}")
def _(x):
    return x.files().select("id", expr.last_parts("path", 2).alias("label"))


@query("prd14_file_class", f"SELECT page_id, CASE WHEN regexp_extract(lower(path), '\\.[^./]+$', 0) IN ('.c', '.cc', '.cpp', '.cxx') THEN 'source' WHEN regexp_extract(lower(path), '\\.[^./]+$', 0) IN ('.h', '.hh', '.hpp', '.hxx') THEN 'header' WHEN regexp_extract(lower(path), '\\.[^./]+$', 0) IN ('.o', '.so', '.dll') THEN 'object' ELSE 'other' END AS class FROM {v.URLS}")
def _(x):
    return x.url_files().select("page_id", expr.file_class("path").alias("class"))


@query("fn1_fnv1a", "SELECT c_custkey, CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END::BIGINT AS h FROM (SELECT c_custkey, list_reduce([CAST(unicode(c) AS HUGEINT) FOR c IN string_split(c_name, '')], lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) AS h FROM customer)")
def _(x):
    return x.table("customer").select("c_custkey", expr.fnv1a("c_name").alias("h"))


@query("fn3_text_range", f"SELECT id, CASE WHEN len(string_split(content, chr(10))) < 2 THEN '' ELSE substr(string_split(content, chr(10))[1], 3) || chr(10) || substr(string_split(content, chr(10))[2], 1, 4) END AS t FROM {v.FILES}")
def _(x):
    return x.files().select("id", expr.text_range("content", F.lit(1), F.lit(3), F.lit(2), F.lit(5)).alias("t"))


@query("fn4_escape", "SELECT page_id, sha1(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS h FROM pages")
def _(x):
    return x.table("pages").select("page_id", F.sha1(expr.html_escape("html")).alias("h"))


@query("fn9_path_split", f"SELECT page_id, regexp_extract(path, '^(.*/)[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM {v.URLS}")
def _(x):
    return x.url_files().select("page_id", expr.directory_with_slash("path").alias("dir"), expr.filename("path").alias("name"))


@query("fn14_tokens", f"SELECT doc_id, count(*) AS n, count(DISTINCT term) AS terms, max(term) AS last FROM {v.POSTINGS} GROUP BY doc_id")
def _(x):
    return search.postings(x.table("documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("term").alias("terms"), F.max("term").alias("last"))


@query("fn17_line_column", f"SELECT id, len(string_split(substr(content, 1, length(content) // 2), chr(10)))::BIGINT AS line, (length(string_split(substr(content, 1, length(content) // 2), chr(10))[-1]) + 1)::BIGINT AS col FROM {v.FILES}")
def _(x):
    p = expr.line_and_column("content", F.floor(F.length("content") / 2))
    return x.files().select("id", p["line"].cast("long").alias("line"), p["column"].cast("long").alias("col"))


@query("src2_directories", f"SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS path, array_to_string(list_slice(string_split(path, '/'), 1, i - 1), '/') AS parent FROM {v.FILES}, unnest(range(2, len(string_split(path, '/')))) u(i)")
def _(x):
    return paths.directories(x.files())


@query("src3_contents", f"SELECT hash, {ints('max(length(content))')} AS n, count(*) AS files FROM {v.FILES} GROUP BY hash")
def _(x):
    return x.files().groupBy("hash").agg(F.max(F.length("content")).cast("long").alias("n"), F.count("*").alias("files"))



from . import fact_bindings, more_bindings, nav_bindings  # noqa: E402, F401  register their queries
