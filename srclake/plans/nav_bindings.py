"""Navigation queries over nodes, relations and names made of the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.nav import Navigation
from ..operators.nav_py import PythonNavigation
from .bindings import query
from .views import Views

#: All definitions are asked for.
_IN = "(SELECT p_partkey FROM part)"

#: Parts are function definitions of ten lines in one of 50 files; line items are uses, reads and writes of them.
NODES = """(
SELECT p_partkey AS id, p_partkey AS entity_hash, p_name AS ast_value, 'Function' AS symbol_type, 'Definition' AS ast_type, true AS visible,
       CAST(p_partkey % 50 AS BIGINT) AS file_id, CAST(p_partkey // 50 * 10 + 1 AS INTEGER) AS start_line, 1 AS start_col, CAST(p_partkey // 50 * 10 + 10 AS INTEGER) AS end_line, 1 AS end_col FROM part
UNION ALL
SELECT 10000000 + l_orderkey * 10 + l_linenumber, min(l_partkey), 'use', CASE WHEN min(l_returnflag) = 'N' AND l_linenumber <> 5 THEN 'Variable' ELSE 'Function' END,
       CASE WHEN l_linenumber = 4 THEN 'Declaration' WHEN l_linenumber = 5 THEN 'VirtualCall' WHEN l_linenumber = 6 THEN 'UnDefinition' WHEN min(l_returnflag) = 'R' THEN 'Usage' WHEN min(l_returnflag) = 'A' THEN 'Read' ELSE 'Write' END, l_linenumber % 2 = 1 OR l_orderkey % 2 = 1,
       l_orderkey % 50, CAST(l_orderkey % 211 AS INTEGER), CAST(l_linenumber AS INTEGER), CAST(l_orderkey % 211 AS INTEGER), CAST(l_linenumber + 1 AS INTEGER) FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
#: A part derives from the part of half its number; suppliers' first and last parts override each other.
_INHERIT = "(SELECT p_partkey AS derived, p_partkey // 2 AS base FROM part WHERE p_partkey >= 2)"
_OVERRIDE = "(SELECT p_partkey AS lhs, p_partkey // 3 AS rhs FROM part WHERE p_partkey >= 3)"
_ASSIGN = "(SELECT p_partkey AS lhs, p_partkey // 5 AS rhs FROM part WHERE p_partkey >= 5)"


def _ids(x: Views) -> DataFrame:
    return x.table("part").select(F.col("p_partkey").alias("id"))


def _facts(x: Views) -> dict[str, DataFrame]:
    p, li = x.table("part"), x.table("lineitem")
    block = F.floor(F.col("p_partkey") / 50) * 10
    d = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("entity_hash"), F.col("p_name").alias("ast_value"), F.lit("Function").alias("symbol_type"), F.lit("Definition").alias("ast_type"), F.lit(True).alias("visible"), (F.col("p_partkey") % 50).alias("file_id"), (block + 1).cast("int").alias("start_line"), F.lit(1).alias("start_col"), (block + 10).cast("int").alias("end_line"), F.lit(1).alias("end_col"))
    flag, line = F.col("flag"), F.col("l_linenumber")
    u = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("entity_hash"), F.min("l_returnflag").alias("flag"))
    u = u.select((10_000_000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "entity_hash", F.lit("use").alias("ast_value"), F.when((flag == "N") & (line != 5), "Variable").otherwise("Function").alias("symbol_type"), F.when(line == 4, "Declaration").when(line == 5, "VirtualCall").when(line == 6, "UnDefinition").when(flag == "R", "Usage").when(flag == "A", "Read").otherwise("Write").alias("ast_type"), ((line % 2 == 1) | (F.col("l_orderkey") % 2 == 1)).alias("visible"), (F.col("l_orderkey") % 50).alias("file_id"), (F.col("l_orderkey") % 211).cast("int").alias("start_line"), F.col("l_linenumber").cast("int").alias("start_col"), (F.col("l_orderkey") % 211).cast("int").alias("end_line"), (F.col("l_linenumber") + 1).cast("int").alias("end_col"))
    key = F.col("p_partkey")
    fn = p.select(key.alias("ast_node_id"), key.alias("entity_hash"), F.concat("p_name", F.lit("()")).alias("name"), F.col("p_name").alias("qualified_name"), F.floor(key / 4).alias("type_hash"), F.filter(F.array(key - 1, key - 2, key - 3), lambda k: k >= 1).alias("parameters"), F.array(F.floor(key / 5)).alias("locals"), F.array(F.col("p_brand")).alias("tags"))
    return {
        "ast_node": d.unionByName(u), "function": fn,
        "inheritance": p.where("p_partkey >= 2").select(key.alias("derived"), F.floor(key / 2).alias("base")),
        "relation": p.where("p_partkey >= 3").select(key.alias("lhs"), F.floor(key / 3).alias("rhs"), F.lit("Override").alias("kind")).unionByName(p.where("p_partkey >= 5").select(key.alias("lhs"), F.floor(key / 5).alias("rhs"), F.lit("Assign").alias("kind"))),
        "record": p.select(key.alias("ast_node_id"), key.alias("entity_hash"), F.concat("p_brand", F.lit("::"), "p_name").alias("qualified_name"), (key % 3 == 0).alias("is_abstract"), F.col("p_type").alias("context")),
        "macro_expansion": p.select(key.alias("ast_node_id"), F.col("p_type").alias("expansion")),
        "member_type": p.select(F.floor(key / 10).alias("type_hash"), key.alias("member_ast_node"), F.when(key % 2 == 0, "Field").otherwise("Method").alias("kind"), F.lit("public").alias("visibility")),
        "friendship": p.where("p_partkey >= 7").select(F.floor(key / 7).alias("target"), key.alias("the_friend")),
        "typed_entity": p.select(key.alias("ast_node_id"), key.alias("entity_hash"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"), F.floor(key / 6).alias("type_hash"), F.when(key % 2 == 0, "Variable").otherwise("Typedef").alias("kind")),
        "enumeration": p.select(key.alias("ast_node_id"), key.alias("entity_hash"), F.array(key, F.floor(key / 2)).alias("constants")),
    }


def _rf(name: str, kind: str, sql: str) -> None:
    @query(name, sql)
    def _(x):
        return getattr(Navigation(_facts(x)), kind)(_ids(x)).select("query_id", "id")


def _same(cond: str) -> str:
    return f"SELECT q.id AS query_id, n.id FROM {NODES} q JOIN {NODES} n USING (entity_hash) WHERE q.id IN {_IN} AND {cond}"


def _hop(rel: str, key: str, value: str) -> str:
    return f"SELECT DISTINCT r.{key} AS query_id, n.id FROM {rel} r JOIN {NODES} n ON n.entity_hash = r.{value} AND n.ast_type = 'Definition' WHERE r.{key} IN {_IN}"


def _closure(a: str, b: str) -> str:
    return f"WITH RECURSIVE c(q, h) AS (SELECT {a}, {b} FROM {_OVERRIDE} WHERE {a} IN {_IN} UNION SELECT c.q, o.{b} FROM c JOIN {_OVERRIDE} o ON o.{a} = c.h) SELECT q AS query_id, min(n.id) AS id FROM c JOIN {NODES} n ON n.entity_hash = c.h GROUP BY q, c.h"


def _reached(edges: str, cond: str) -> str:
    """Nodes of the entity itself and of all that the edges reach from it."""
    return f"WITH RECURSIVE c(q, h) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT c.q, o.rhs FROM c JOIN {edges} o ON o.lhs = c.h) SELECT q AS query_id, n.id FROM c JOIN {NODES} n ON n.entity_hash = c.h AND {cond}"


_INSIDE = "c.file_id = d.file_id AND (c.start_line, c.start_col) >= (d.start_line, d.start_col) AND (c.end_line, c.end_col) < (d.end_line, d.end_col)"
_CALLS = f"(SELECT d.id AS query_id, c.id, c.entity_hash FROM {NODES} d JOIN {NODES} c ON {_INSIDE} WHERE d.id IN {_IN} AND c.symbol_type = 'Function' AND c.ast_type IN ('Usage', 'VirtualCall'))"

_rf("rf1_definition", "definition", _same("n.ast_type = 'Definition'"))
_rf("rf2_declaration", "declaration", _same("n.ast_type = 'Declaration' AND n.visible"))
_rf("rf3_usage", "usage", _same("true"))
_rf("rf4_this_calls", "this_calls", f"SELECT query_id, id FROM {_CALLS}")
_rf("rf5_calls_of_this", "calls_of_this", _same("n.ast_type = 'Usage'"))
_rf("rf6_callee", "callee", f"SELECT DISTINCT query_id, entity_hash AS id FROM {_CALLS}")
_rf("rf7_caller", "caller", f"SELECT DISTINCT c.entity_hash AS query_id, d.id FROM {NODES} c JOIN {NODES} d ON {_INSIDE} AND d.symbol_type = 'Function' AND d.ast_type = 'Definition' WHERE c.ast_type = 'Usage' AND c.entity_hash IN {_IN}")
_rf("rf8_virtual_call", "virtual_call", _reached(_OVERRIDE, "n.ast_type = 'VirtualCall'"))
_rf("rf9_func_ptr_call", "func_ptr_call", _reached(_ASSIGN, "n.ast_type = 'Usage'"))
_rf("rf10_parameter", "parameter", f"SELECT p_partkey AS query_id, p_partkey - k AS id FROM part, (VALUES (1), (2), (3)) v(k) WHERE p_partkey IN {_IN} AND p_partkey - k >= 1")
_rf("rf11_local_var", "local_var", f"SELECT p_partkey AS query_id, p_partkey // 5 AS id FROM part WHERE p_partkey IN {_IN}")
_rf("rf12_return_type", "return_type", _hop("(SELECT p_partkey AS a, p_partkey // 4 AS b FROM part)", "a", "b"))
_rf("rf13_overrides", "overrides", _closure("lhs", "rhs"))
_rf("rf14_overridden_by", "overridden_by", _closure("rhs", "lhs"))
_rf("rf15_read", "read", _same("n.ast_type = 'Read'"))
_rf("rf15_write", "write", _same("n.ast_type = 'Write'"))
_rf("rf16_type", "type", _hop("(SELECT p_partkey AS a, p_partkey // 6 AS b FROM part WHERE p_partkey % 2 = 0)", "a", "b"))
_rf("rf17_alias", "alias", f"SELECT p_partkey // 6 AS query_id, p_partkey AS id FROM part WHERE p_partkey % 2 = 1 AND p_partkey // 6 IN {_IN}")
_rf("rf18_inherit_from", "inherit_from", _hop(_INHERIT, "derived", "base"))
_rf("rf18_inherit_by", "inherit_by", _hop(_INHERIT, "base", "derived"))
_rf("rf19_data_member", "data_member", f"SELECT p_partkey // 10 AS query_id, p_partkey AS id FROM part WHERE p_partkey % 2 = 0 AND p_partkey // 10 IN {_IN}")
_rf("rf20_method", "method", f"SELECT p_partkey // 10 AS query_id, p_partkey AS id FROM part WHERE p_partkey % 2 = 1 AND p_partkey // 10 IN {_IN}")
_rf("rf21_friend", "friend", _hop("(SELECT p_partkey // 7 AS a, p_partkey AS b FROM part WHERE p_partkey >= 7)", "a", "b"))
_rf("rf22_underlying_type", "underlying_type", _hop("(SELECT p_partkey AS a, p_partkey // 6 AS b FROM part WHERE p_partkey % 2 = 1)", "a", "b"))
_rf("rf23_enum_constants", "enum_constants", f"SELECT p_partkey AS query_id, c AS id FROM part, unnest([p_partkey, p_partkey // 2]) u(c) WHERE p_partkey IN {_IN}")
_rf("rf25_undefinition", "undefinition", _same("n.ast_type = 'UnDefinition'"))


@query("rf18_inherit_from_count", f"SELECT derived AS query_id, count(*) AS n FROM {_INHERIT} WHERE derived IN {_IN} GROUP BY derived")
def _(x):
    return Navigation(_facts(x)).inherit_from_count(_ids(x))


@query("rf19_data_member_count", f"SELECT p_partkey // 10 AS query_id, count(*) AS n FROM part WHERE p_partkey % 2 = 0 AND p_partkey // 10 IN {_IN} GROUP BY 1")
def _(x):
    return Navigation(_facts(x)).data_member_count(_ids(x))


@query("rf24_expansion", "SELECT p_partkey AS query_id, p_type AS ast_value FROM part")
def _(x):
    return Navigation(_facts(x)).expansion(_ids(x)).select("query_id", "ast_value")


@query("rf27_tags", "SELECT p_partkey AS query_id, 'public,' || p_brand AS tags FROM part")
def _(x):
    return Navigation(_facts(x)).tags(_ids(x)).select("query_id", F.array_join("tags", ",").alias("tags"))


@query("rf28_properties", "SELECT p_partkey AS query_id, 'Function' AS kind, p_name AS name FROM part")
def _(x):
    p = Navigation(_facts(x)).properties(_ids(x))
    return p.select("query_id", F.col("properties")["Kind"].alias("kind"), F.col("properties")["Qualified name"].alias("name"))


#: Nodes of three kinds, by the remainder modulo 3: functions, types, variables (even parts) or typedefs.
_KINDS = "CASE p_partkey % 3 WHEN 0 THEN 'Function' WHEN 1 THEN 'Type' ELSE CASE p_partkey % 2 WHEN 0 THEN 'Variable' ELSE 'Typedef' END END"


@query("rf28_by_kind", f"SELECT p.p_partkey AS query_id, {_KINDS.replace('p_partkey', 'p.p_partkey')} AS kind, CASE p.p_partkey % 3 WHEN 1 THEN p.p_brand || '::' || p.p_name ELSE p.p_name END AS qualified, CASE p.p_partkey % 3 WHEN 0 THEN p.p_name || '()' END AS signature, CASE WHEN p.p_partkey % 6 = 2 THEN t.p_brand || '::' || t.p_name END AS type, CASE WHEN p.p_partkey % 3 = 1 THEN p.p_type END AS context FROM part p LEFT JOIN part t ON t.p_partkey = p.p_partkey // 6")
def _(x):
    facts = _facts(x)
    k = F.col("id")
    kind = F.when(k % 3 == 0, "Function").when(k % 3 == 1, "Type").when(k % 2 == 0, "Variable").otherwise("Typedef")
    facts["ast_node"] = facts["ast_node"].where("ast_type = 'Definition'").withColumn("symbol_type", kind)
    p = Navigation(facts).properties(_ids(x))
    at = lambda key, name: F.col("properties")[key].alias(name)
    return p.select("query_id", at("Kind", "kind"), at("Qualified name", "qualified"), at("Signature", "signature"), at("Type", "type"), at("Context", "context"))


@query("rf30_highlight", r"WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS t FROM documents), p AS (SELECT doc_id, line, string_split_regex(t, '\bwith\b') AS xs FROM l WHERE regexp_matches(t, '\bwith\b')) SELECT doc_id AS query_id, line, CAST(list_sum([length(x) FOR x IN list_slice(xs, 1, i)]) + (i - 1) * 4 + 1 AS BIGINT) AS start_col FROM p, unnest(range(1, len(xs))) u(i)")
def _(x):
    """Each document is a node that spans its lines."""
    d = x.table("documents").where("text IS NOT NULL")
    node = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("entity_hash"), F.lit("d").alias("ast_value"), F.lit("File").alias("symbol_type"), F.lit("Usage").alias("ast_type"), F.lit(True).alias("visible"), F.col("doc_id").alias("file_id"), F.lit(1).alias("start_line"), F.lit(1).alias("start_col"), F.size(F.split("text", "\n")).alias("end_line"), F.lit(1).alias("end_col"))
    facts = {"ast_node": node, "file": d.select(F.col("doc_id").alias("id"), F.sha1("text").alias("content_hash")), "file_content": d.select(F.sha1("text").alias("hash"), F.col("text").alias("content")).dropDuplicates(["hash"])}
    return Navigation(facts).highlight(d.select(F.col("doc_id").alias("id")), "with").select("query_id", F.col("line").cast("long").alias("line"), F.col("start_col").cast("long").alias("start_col"))


@query("rf32_in_file", f"SELECT q.id AS query_id, n.id FROM {NODES} q JOIN {NODES} n USING (entity_hash) WHERE q.id IN {_IN} AND n.file_id = 3")
def _(x):
    return Navigation(_facts(x)).references(_ids(x), "usage", in_file=3).select("query_id", "id")


@query("rf32_page", f"SELECT q.id AS query_id, n.id FROM {NODES} q JOIN {NODES} n USING (entity_hash) WHERE q.id IN {_IN} AND n.id IN (SELECT DISTINCT n.id FROM {NODES} q JOIN {NODES} n USING (entity_hash) WHERE q.id IN {_IN} AND n.id > 100 ORDER BY 1 LIMIT 30)")
def _(x):
    return Navigation(_facts(x)).references(_ids(x), "usage", page=(30, 100)).select("query_id", "id")


@query("rf26_file_functions", f"SELECT id, ast_value FROM {NODES} WHERE file_id = 3 AND symbol_type = 'Function' AND ast_type = 'Definition'")
def _(x):
    return Navigation(_facts(x)).file_references(3, "functions").select("id", "ast_value")


@query("rf31_node_at", f"SELECT id FROM {NODES} WHERE visible AND file_id = 3 AND (start_line, start_col) <= (53, 1) AND (end_line, end_col) > (53, 1) ORDER BY start_line DESC, start_col DESC, end_line, end_col, id LIMIT 1")
def _(x):
    return Navigation(_facts(x)).node_at(3, 53, 1).select("id")


@query("gr21_call_diagram", f"SELECT DISTINCT query_id AS src, entity_hash AS dst FROM {_CALLS} UNION SELECT d.id, c.entity_hash FROM {NODES} c JOIN {NODES} d ON {_INSIDE} AND d.symbol_type = 'Function' AND d.ast_type = 'Definition' WHERE c.ast_type = 'Usage' AND c.entity_hash IN {_IN}")
def _(x):
    return Navigation(_facts(x)).function_call_diagram(_ids(x)).edges.select("src", "dst").distinct()


@query("gr22_class_diagram", f"SELECT derived AS src, base AS dst FROM {_INHERIT} WHERE derived IN {_IN} OR base IN {_IN}")
def _(x):
    return Navigation(_facts(x)).class_diagram(_ids(x)).edges.select("src", "dst").distinct()


_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("gr22_class_labels", f"SELECT q.p_partkey AS id, '<table><tr><td colspan=''2''>' || {_ESCAPED.format('any_value(q.p_name)')} || '</td></tr>' || coalesce(string_agg('<tr><td>+</td><td>' || {_ESCAPED.format('m.p_name')} || '</td></tr>', '' ORDER BY m.p_partkey % 2, m.p_name, m.p_partkey), '') || '</table>' AS label FROM part q LEFT JOIN part m ON m.p_partkey // 10 = q.p_partkey GROUP BY q.p_partkey")
def _(x):
    return Navigation(_facts(x)).class_diagram(_ids(x)).nodes.select("id", F.col("attrs")["label"].alias("label"))


@query("gr27_clusters", "WITH f AS (SELECT p_partkey AS id, '/' || p_brand || '/' || p_type AS dir, '/' || p_brand AS up FROM part WHERE p_partkey IN (SELECT p_partkey FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey // 2 FROM part WHERE p_partkey >= 2)) SELECT dir AS cluster, any_value(up) AS parent, count(*) AS n FROM f GROUP BY dir UNION ALL SELECT DISTINCT up, NULL, 0 FROM f")
def _(x):
    edges = x.table("part").where("p_partkey >= 2").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))
    path = F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), F.col("p_partkey").cast("string"))
    g = graph.Graph.of(edges).by_directory(x.table("part").select(F.col("p_partkey").alias("id"), path.alias("path")))
    n = g.members.groupBy("cluster").agg(F.count("*").alias("n"))
    return g.clusters.join(n, "cluster", "left").select("cluster", "parent", F.coalesce("n", F.lit(0)).alias("n"))


# --- Python names: parts define (functions and statements), line items use ------------------------------------------

NAMES = """(
SELECT p_partkey AS id, p_partkey AS ref_id, p_partkey // 8 AS parent, p_partkey // 20 AS parent_function, true AS is_definition, false AS is_import, false AS is_call, CASE p_partkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'statement' ELSE 'astparam' END AS type, p_partkey % 9 AS file_id, CAST(p_partkey AS INTEGER) AS line_start FROM part
UNION ALL
SELECT 10000000 + l_orderkey * 10 + l_linenumber, min(l_partkey), min(l_suppkey), min(l_suppkey) // 2, false, min(l_returnflag) = 'A', min(l_returnflag) = 'R', CASE WHEN l_linenumber = 1 THEN 'annotation' WHEN l_linenumber = 2 THEN 'baseclass' ELSE 'statement' END, l_orderkey % 9, CAST(l_orderkey AS INTEGER) FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def _names(x: Views) -> DataFrame:
    key = F.col("p_partkey")
    rest = {"is_builtin": F.lit(False), "full_name": F.lit(""), "value": F.lit("v"), "type_hint": F.lit(""), "line_end": F.lit(1), "column_start": F.lit(1), "column_end": F.lit(2)}
    d = x.table("part").select(key.alias("id"), key.alias("ref_id"), F.floor(key / 8).alias("parent"), F.floor(key / 20).alias("parent_function"), F.lit(True).alias("is_definition"), F.lit(False).alias("is_import"), F.lit(False).alias("is_call"), F.when(key % 3 == 0, "function").when(key % 3 == 1, "statement").otherwise("astparam").alias("type"), (key % 9).alias("file_id"), key.cast("int").alias("line_start"))
    u = x.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("ref_id"), F.min("l_suppkey").alias("parent"), F.min("l_returnflag").alias("flag"))
    n = F.col("l_linenumber")
    u = u.select((10_000_000 + F.col("l_orderkey") * 10 + n).alias("id"), "ref_id", "parent", F.floor(F.col("parent") / 2).alias("parent_function"), F.lit(False).alias("is_definition"), (F.col("flag") == "A").alias("is_import"), (F.col("flag") == "R").alias("is_call"), F.when(n == 1, "annotation").when(n == 2, "baseclass").otherwise("statement").alias("type"), (F.col("l_orderkey") % 9).alias("file_id"), F.col("l_orderkey").cast("int").alias("line_start"))
    return d.unionByName(u).withColumns(rest)


def _py(name: str, kind: str, on: str, cond: str = "true") -> None:
    @query(name, f"SELECT n.id AS query_id, t.id FROM {NAMES} n JOIN {NAMES} t ON {on} WHERE n.id IN {_IN} AND {cond}")
    def _(x):
        return getattr(PythonNavigation(_names(x)), kind)(_ids(x)).select("query_id", "id")


_py("py1_definition", "definition", "t.ref_id = n.ref_id", "t.is_definition AND NOT t.is_import")
_py("py2_usage", "usage", "t.ref_id = n.ref_id AND t.id <> n.id", "NOT t.is_definition")
_py("py3_method", "method", "t.parent = n.ref_id", "t.type = 'function' AND t.is_definition")
_py("py4_data_member", "data_member", "t.parent = n.ref_id", "t.type = 'statement' AND t.is_definition")
_py("py5_parent", "parent", "t.id = n.parent")
_py("py5_parent_function", "parent_function", "t.id = n.parent_function")
_py("py6_parameter", "parameter", "t.parent = n.ref_id", "t.type = 'astparam' AND t.is_definition")
_py("py7_caller", "caller", "t.ref_id = n.ref_id AND t.id <> n.id", "t.is_call AND NOT t.is_definition")
_py("py8_this_calls", "this_calls", "t.parent = n.id", "t.is_call")
_py("py9_annotation", "annotation", "t.parent = n.id", "t.type = 'annotation'")


@query("py10_base_class", f"SELECT DISTINCT n.id AS query_id, d.id FROM {NAMES} n JOIN {NAMES} b ON b.parent = n.id AND b.type = 'baseclass' JOIN {NAMES} d ON d.ref_id = b.ref_id AND d.is_definition AND NOT d.is_import WHERE n.id IN {_IN}")
def _(x):
    return PythonNavigation(_names(x)).base_class(_ids(x)).select("query_id", "id")


@query("py11_in_file", f"SELECT id FROM {NAMES} WHERE file_id = 4 AND is_definition AND NOT is_import")
def _(x):
    return PythonNavigation(_names(x)).in_file(4, True).select("id")


@query("gr25_module_diagram", f"SELECT DISTINCT u.file_id AS src, d.file_id AS dst FROM {NAMES} u JOIN {NAMES} d ON u.ref_id = d.ref_id AND d.is_definition AND NOT d.is_import WHERE (NOT u.is_definition OR u.is_import) AND u.file_id <> d.file_id AND (u.file_id = 4 OR d.file_id = 4)")
def _(x):
    return PythonNavigation(_names(x)).module_diagram(4)


_RESOLVED = f"(SELECT ref_id AS r, id AS d FROM {NAMES} WHERE is_definition AND NOT is_import)"


@query("gr24_call_diagram", f"SELECT n.id AS src, coalesce(d, t.id) AS dst FROM {NAMES} n JOIN {NAMES} t ON t.parent = n.id AND t.is_call LEFT JOIN {_RESOLVED} ON r = t.ref_id WHERE n.id IN {_IN} UNION SELECT coalesce(t.parent_function, t.parent), n.id FROM {NAMES} n JOIN {NAMES} t ON t.ref_id = n.ref_id AND t.id <> n.id WHERE t.is_call AND NOT t.is_definition AND n.id IN {_IN}")
def _(x):
    return PythonNavigation(_names(x)).call_diagram(_ids(x)).edges.select("src", "dst").distinct()


@query("gr26_usage_diagram", f"SELECT DISTINCT t.id AS src, n.id AS dst FROM {NAMES} n JOIN {NAMES} t ON t.ref_id = n.ref_id AND t.id <> n.id WHERE NOT t.is_definition AND n.id IN {_IN}")
def _(x):
    return PythonNavigation(_names(x)).usage_diagram(_ids(x)).edges.select("src", "dst")


@query("gr26_class_diagram", f"SELECT DISTINCT n.id AS src, d.id AS dst FROM {NAMES} n JOIN {NAMES} b ON b.parent = n.id AND b.type = 'baseclass' JOIN {NAMES} d ON d.ref_id = b.ref_id AND d.is_definition AND NOT d.is_import WHERE n.id IN {_IN}")
def _(x):
    return PythonNavigation(_names(x)).class_diagram(_ids(x)).edges.select("src", "dst")


@query("py12_properties", f"SELECT id AS query_id, CASE WHEN is_call THEN 'true' ELSE 'false' END AS call FROM {NAMES} WHERE id IN {_IN}")
def _(x):
    return PythonNavigation(_names(x)).properties(_ids(x)).select("query_id", F.col("properties")["Function call"].alias("call"))


@query("py13_in_file", f"SELECT id FROM {NAMES} WHERE file_id = 5")
def _(x):
    return PythonNavigation(_names(x)).in_file(5).select("id")
