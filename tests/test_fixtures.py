"""Golden values on small fact tables (FIXTURES.md)."""

import math

import pytest
from pyspark.sql import functions as F

from srclake.functions import expr
from srclake.operators import graph, history, loc, maintenance, metrics, paths, ranges, search
from srclake.operators.nav import Navigation
from srclake.operators.nav_py import PythonNavigation
from srclake.sources import files, python_names
from srclake.store import SCHEMAS


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize(("fields", "methods", "pairs", "loc_", "hs"), [
    (0, 0, [], 0, 0), (2, 0, [], 0, 0), (0, 3, [], 0, 0),
    (1, 1, [(0, 0)], 0, math.nan), (2, 1, [(0, 0), (0, 1)], 0, math.nan),
    (1, 2, [(0, 0), (1, 0)], 0, 0), (3, 3, [(m, f) for m in range(3) for f in range(3)], 0, 0),
    (1, 1, [], 1, math.nan), (1, 2, [], 1, 2), (2, 2, [], 1, 2), (1, 2, [(0, 0)], 0.5, 1), (2, 1, [(0, 1)], 0.5, math.nan),
    (2, 2, [(0, 0)], 0.75, 1.5), (2, 2, [(0, 0), (1, 1)], 0.5, 1), (2, 2, [(0, 0), (0, 1), (1, 1)], 0.25, 0.5),
])
def test_cohesion(spark, fields, methods, pairs, loc_, hs):
    t = spark.createDataFrame([(1,)], "type long")
    f = spark.createDataFrame([(1, i) for i in range(fields)], "type long, field long")
    m = spark.createDataFrame([(1, i) for i in range(methods)], "type long, method long")
    u = spark.createDataFrame([*pairs, *pairs], "method long, field long")
    (r,) = metrics.cohesion(t, f, m, u).collect()
    assert r["loc"] == loc_
    assert r["loc_hs"] == hs or (math.isnan(hs) and math.isnan(r["loc_hs"]))


def test_modules(spark):
    place = {"A1": "a", "A2": "a", "B1": "b", "B2": "b", "C1": "c", "C2": "c", "D1": "d"}
    nodes = spark.createDataFrame([(e, f"/m/module_{m}/{e}", "Definition") for e, m in place.items()], "entity string, path string, ast_type string")
    deps = spark.createDataFrame([("A2", "B1"), ("C1", "B1"), ("C2", "A2"), ("C2", "B1"), ("D1", "C1"), ("D1", "C2"), ("D1", "C2")], "entity string, dependency string")
    mods = spark.createDataFrame([(f"/m/module_{m}",) for m in "abcd"], "dir string")
    at = metrics.located(deps, nodes)
    assert [r[1] for r in rows(metrics.module_efferent(mods, at), "dir", "value")] == [1, 0, 2, 2]
    assert [r[1] for r in rows(metrics.module_afferent(mods, at), "dir", "value")] == [1, 3, 1, 0]
    assert dict(rows(metrics.efferent(nodes, deps), "entity", "value"))["C2"] == 2
    assert dict(rows(metrics.afferent(nodes, deps), "entity", "value"))["B1"] == 3


@pytest.mark.parametrize(("types", "edges", "value"), [(3, [(0, 1), (1, 2), (0, 1)], 4 / 3), (1, [], 1.0), (4, [(0, 1)], 0.5), (0, [], 0.0)])
def test_relational_cohesion(spark, types, edges, value):
    nodes = spark.createDataFrame([(i, f"/x/m/{i}") for i in range(types)], "entity long, path string")
    deps = spark.createDataFrame(edges, "entity long, dependency long")
    mods = spark.createDataFrame([("/x/m",)], "dir string")
    assert metrics.relational_cohesion(mods, metrics.located(deps, nodes), nodes).first()["value"] == pytest.approx(value)


def test_bumpy_road_and_parameters(spark):
    f = spark.createDataFrame([(1, 0, 0, []), (2, 29, 8, [7, 8]), (3, 4, 3, [9])], "ast_node_id long, bumpiness int, statement_count int, parameters array<long>")
    assert rows(metrics.bumpy_road(f), "ast_node_id", "value") == [(1, 1.0), (2, 29 / 8), (3, 4 / 3)]
    assert rows(metrics.parameter_count(f), "ast_node_id", "value") == [(2, 2.0), (3, 1.0)]


EDGES = [(1, 2), (2, 3), (3, 2), (3, 4), (5, 6)]


def test_graph(spark):
    e = spark.createDataFrame(EDGES, "src long, dst long")
    s = spark.createDataFrame([(1,), (2,)], "start long")
    assert rows(graph.closure(e, s), "start", "node") == [(1, 2), (1, 3), (1, 4), (2, 2), (2, 3), (2, 4)]
    assert rows(graph.bfs(e, s.where("start = 1"), 2), "node", "depth") == [(2, 1), (3, 2)]
    assert rows(graph.closure(e, spark.createDataFrame([(4,)], "start long"), True), "node") == [(1,), (2,), (3,)]
    n = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    assert rows(graph.topological_levels(n, e), "id", "level") == [(1, 0), (2, 2), (3, 2), (4, 2), (5, 0), (6, 1)]
    assert rows(graph.bfs_compat(e, 1, 1), "src", "dst") == [(1, 2)]
    assert rows(graph.bfs_compat(e, 1, -1), "src", "dst") == [(1, 2), (2, 3), (3, 2), (3, 4)]
    assert graph.bfs_compat(e, 1, -2).count() == 0
    assert rows(graph.impact(e.toDF("includer", "included"), spark.createDataFrame([(4,)], "file_id long")), "file_id") == [(1,), (2,), (3,), (4,)]
    g = graph.Graph.of(e).with_attribute(1, "label", "a").without_edge(5, 6)
    assert g.has_edge(1, 2) and not g.has_edge(5, 6) and rows(g.children(3), "id") == [(2,), (4,)]
    assert files.dot(g).startswith("digraph G {\n  \"1\" [label=\"a\"];")


def test_prefixes(spark):
    p = spark.createDataFrame([("/a/b/x",), ("/a/bc/x",), ("/a/b_c/x",), ("/a/bxc/x",)], "path string")
    d = spark.createDataFrame([("/a/b",), ("/a/b_c",)], "dir string")
    assert rows(paths.members(p, d), "dir", "path") == [("/a/b", "/a/b/x"), ("/a/b_c", "/a/b_c/x")]
    assert len(rows(paths.members(p, d, raw_prefix=True), "dir", "path")) == 6
    t = spark.createDataFrame([("/a", True), ("/a/b", True), ("/a/z", False), ("/a/b/q", False)], "path string, is_dir boolean")
    assert [r["path"] for r in paths.children(t, "/a").collect()] == ["/a/b", "/a/z"]
    assert [r["path"] for r in paths.subtree(t, "/a").collect()] == ["/a", "/a/b", "/a/b/q", "/a/z"]
    assert [r["path"] for r in paths.path_to_root(t, "/a/b/q").collect()] == ["/a/b/q", "/a/b", "/a"]


def test_lines_of_code(spark):
    text = "int a; // one\n\n   \nint b; /* x // y */ int c;\n/* open"
    f = spark.createDataFrame([(1, "CPP", text), (2, "CPP", ""), (3, "Unknown", "a\n\nb")], "id long, type string, content string")
    assert rows(loc.lines_of_code(f), "id", "type", "metric") == [(1, 1, 5), (1, 2, 3), (1, 3, 2), (3, 1, 3), (3, 2, 2), (3, 3, 2)]
    assert loc.without_comments("a /* b */ c", "//", "/*", "*/") == "a  c"
    assert loc.without_comments("abc /* open", "//", "/*", "*/") == "abc "
    assert loc.without_comments("x\n=begin\ny\n=end\nz", "#", "=begin", "\n=end") == "x\nz"
    assert loc.without_comments("ab //* c\n */ d", "//", "/*", "*/") == "ab \n */ d"


def test_containment(spark):
    cols = "file_id long, id long, start_line int, start_col int, end_line int, end_col int"
    outer = spark.createDataFrame([(1, 1, 1, 1, 5, 1)], cols)
    inner = spark.createDataFrame([(1, 10, 1, 1, 2, 1), (1, 11, 2, 1, 5, 1), (1, 12, 5, 1, 6, 1), (1, 13, 1, 1, 5, 1), (2, 14, 2, 1, 3, 1)], cols)
    for b in (None, 2):
        assert rows(ranges.within(inner, outer, bucket_lines=b).select("inner.id"), "id") == [(10,)]
        assert rows(ranges.within_inclusive(inner, outer, "file_id", b).select("inner.id"), "id") == [(10,), (11,), (13,)]


def test_search(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma\nbeta_x Alpha"), (2, "gamma alpha"), (3, "")], "doc_id long, text string")
    p = search.postings(d)
    assert rows(search.phrase(p, ["alpha", "beta"]), "doc_id", "position") == [(1, 0)]
    assert rows(search.boolean(p, ["alpha"], ["beta"]), "doc_id") == [(2,)]
    assert rows(search.wildcard(p, "beta?x"), "doc_id", "hits") == [(1, 1)]
    assert search.proximity(p, ["alpha"]).count() == 0
    assert rows(search.proximity(p, ["gamma", "alpha"]), "doc_id", "first", "last") == [(1, 2, 4), (2, 0, 1)]
    assert search.proximity_matches([[0, 41], [20]]) == [(0, 20, pytest.approx(3 - (19 / 21) ** 2))]
    assert search.proximity_matches([[0], [21]]) == []
    assert search.proximity_matches([[1], [0]], swapped=False) == []
    assert search.proximity_matches([[3, 7], [3, 4]])[0] == (3, 4, 3.0)
    m = spark.createDataFrame([(1, 0, 9), (1, 2, 5), (1, 6, 12)], "doc_id long, first int, last int")
    assert rows(search.without_overlaps(m), "first", "last") == [(2, 5), (6, 12)]


def test_history(spark):
    c = spark.createDataFrame([(str(i), f"m{i}", "Ann" if i % 2 else "Bob", "x", i, [str(i - 1)] if i else []) for i in range(5)], SCHEMAS["commit"])
    assert [r["oid"] for r in history.log(c, 2, 1).collect()] == ["3", "2"]
    assert [r["oid"] for r in history.log(c, 2, 1, compat=True).collect()] == ["4", "3"]
    assert history.log(c, -1).count() == 5 and history.log(c, -1, compat=True).count() == 0
    assert [r["oid"] for r in history.log(c, -1, 0, "ann").collect()] == ["3", "1"]
    assert rows(history.ancestors_of(c, "2"), "oid") == [("0",), ("1",), ("2",)]
    b = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate("AABA")], SCHEMAS["blame_line"])
    assert rows(history.blame_hunks(b), "first_line", "commit_oid", "n_lines") == [(1, "A", 2), (3, "B", 1), (4, "A", 1)]
    assert "-b" in history.diff("a\nb\n", "a\nc\n")


def test_maintenance(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, hash string")
    assert rows(maintenance.changes(old, new), "path", "status") == [("b", "MODIFIED"), ("c", "DELETED")]
    assert rows(maintenance.changes(old, new, added=True), "path", "status")[-1] == ("d", "ADDED")
    assert not maintenance.needs_full_rebuild(10, 100) and maintenance.needs_full_rebuild(11, 100)


def test_statistics(spark):
    s = spark.createDataFrame([("a", "k", 1), ("b", "k", 2), ("b", "l", 5)], SCHEMAS["statistics"])
    assert [r for r in rows(metrics.with_summary(s), "group", "key", "value") if r[0] == "Summary"] == [("Summary", "k", 3), ("Summary", "l", 5)]
    with pytest.raises(ValueError):
        metrics.page(s, "key", 0)


def test_expressions(spark):
    x = spark.createDataFrame([("ab\ncdef\ngh <&>", "/p/q/r.CPP")], "t string, p string")
    get = lambda c: x.select(c.alias("v")).first()["v"]
    assert get(expr.text_range("t", F.lit(1), F.lit(2), F.lit(3), F.lit(2))) == "b\ncdef\ng"
    assert get(expr.text_range("t", F.lit(2), F.lit(2), F.lit(2), F.lit(4))) == "de"
    assert get(expr.text_range("t", F.lit(1), F.lit(1), F.lit(None).cast("int"), F.lit(1))) == ""
    assert get(expr.html_escape("t")).endswith("&lt;&amp;&gt;")
    assert get(expr.ancestors("p")) == ["/p", "/p/q"] and get(expr.file_class("p")) == "source"
    assert get(expr.last_parts("p", 2)) == ".../q/r.CPP" and get(expr.last_parts("p", 3)) == "/p/q/r.CPP"
    assert get(expr.word_places(F.lit("a b ab a"), "a")) == [1, 8]
    assert get(expr.fnv1a(F.lit("a"))) == 0xAF63DC4C8601EC8C - (1 << 64)
    assert get(expr.connection_with(F.lit("pgsql:host=a;port=1"), "port", "2")) == "pgsql:host=a;port=2"
    assert get(expr.line_and_column("t", F.lit(4))) == (2, 2)


NODES = [
    (1, 100, "f", "Function", "Definition", True, 1, 1, 1, 9, 2), (2, 100, "f", "Function", "Declaration", True, 2, 1, 1, 1, 9), (3, 100, "f", "Function", "Usage", True, 1, 12, 3, 12, 6),
    (4, 200, "g", "Function", "Definition", True, 1, 11, 1, 19, 2), (5, 200, "g", "Function", "Usage", True, 1, 3, 3, 3, 6), (6, 300, "C", "Type", "Definition", True, 1, 30, 1, 40, 2),
    (7, 400, "x", "Variable", "Definition", True, 1, 31, 3, 31, 8), (8, 300, "C", "Type", "Usage", True, 1, 31, 3, 31, 4), (9, 500, "D", "Type", "Definition", True, 1, 50, 1, 60, 2), (10, 600, "~C", "Function", "Declaration", False, 1, 30, 1, None, None),
]


def facts(spark):
    t = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    t["ast_node"] = spark.createDataFrame(NODES, SCHEMAS["ast_node"])
    t["function"] = spark.createDataFrame([(1, 100, "ns::f", 300, None, [7], [], 3, 1, 1, False, ["virtual"]), (4, 200, "ns::g", None, None, [], [7], 1, 0, 0, False, [])], SCHEMAS["function"])
    t["member_type"] = spark.createDataFrame([(300, 7, 300, "Field", "private"), (300, 10, None, "Method", "public"), (300, 1, None, "Method", "public")], SCHEMAS["member_type"])
    t["inheritance"] = spark.createDataFrame([(500, 300, False, "public")], SCHEMAS["inheritance"])
    t["relation"] = spark.createDataFrame([(200, 100, "Override")], SCHEMAS["relation"])
    t["typed_entity"] = spark.createDataFrame([(7, 400, "x", "C::x", 300, "Variable")], SCHEMAS["typed_entity"])
    t["record"] = spark.createDataFrame([(6, 300, "C", False, "", []), (9, 500, "D", False, "", ["TemplateInstantiation"])], SCHEMAS["record"])
    return t


def test_navigation(spark):
    nav = Navigation(facts(spark))
    ids = lambda kind, *q: [r[0] for r in rows(getattr(nav, kind)(list(q)), "id")]
    assert ids("definition", 3) == [1] and ids("declaration", 3) == [2] and ids("usage", 1) == [1, 2, 3]
    assert ids("this_calls", 1) == [5] and ids("callee", 1) == [4] and ids("caller", 1) == [4]
    assert ids("parameter", 1) == [7] and ids("local_var", 4) == [7] and ids("return_type", 1) == [6]
    assert ids("overrides", 4) == [1] and ids("overridden_by", 1) == [4]
    assert ids("inherit_by", 6) == [9] and ids("inherit_from", 9) == [6] and ids("type", 7) == [6]
    assert ids("data_member", 6) == [7] and ids("method", 6) == [1, 10]
    assert nav.node_at(1, 3, 4).first()["id"] == 5 and nav.node_at(1, 31, 3).first()["id"] == 8
    assert nav.tags([1]).first()["tags"] == ["public", "virtual"]
    assert nav.properties([1]).first()["properties"]["Qualified name"] == "ns::f"
    assert rows(nav.function_call_diagram([1]).edges, "src", "dst") == [(1, 4), (4, 1)]
    assert rows(nav.collaboration_diagram([6]), "src", "dst", "label") == [(6, 6, "x")]
    assert rows(metrics.type_mccabe(nav.f["record"], nav.f["member_type"], nav.nodes, nav.f["function"]), "type_hash", "value") == [(300, 3.0)]
    with pytest.raises(LookupError):
        nav.node(99)


def test_python_names(spark):
    src = "class A:\n    x = 1\n    def f(self, a: int) -> int:\n        return g(a)\n\nclass B(A):\n    pass\n\ndef g(n):\n    return n\n\ng(1)\n"
    n = python_names.extract(spark.createDataFrame([(1, "m.py", src), (2, "bad.py", "def (")], "file_id long, path string, content string")).cache()
    nav = PythonNavigation(n, spark.createDataFrame([(1, src)], "file_id long, content string"))
    by = {r["value"]: r["id"] for r in n.where("is_definition").collect()}
    a, b, g = by["class A"], by["class B(A)"], by["def g(n)"]
    assert rows(nav.base_class([b]), "line_start", "value") == [(1, "class A")]
    assert rows(nav.data_member([a]), "value") == [("x",)] and rows(nav.method([a]), "line_start") == [(3,)]
    assert rows(nav.usage([g]), "line_start", "is_call") == [(12, True)]
    assert rows(nav.parameter([g]), "value") == [("n",)]
    assert nav.node_at(1, 12, 1).first()["value"] == "g"
    assert nav.properties([g]).first()["properties"]["Function call"] == "false"


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.cpp").write_text('#include <vector>\n#include "a.h"\nint x;\n')
    (tmp_path / "d" / "b.cpp").write_text('#include <vector>\n#include "a.h"\nint x;\n')
    (tmp_path / "d" / "c.bin").write_bytes(b"\x00\x01")
    f, c = files.register(files.walk(spark, str(tmp_path)))
    kinds = {r["filename"]: r["type"] for r in f.collect()}
    assert kinds["a.cpp"] == "CPP" and kinds["c.bin"] == "Binary" and kinds["d"] == "Dir" and c.count() == 1
    inc = files.includes(spark.createDataFrame([("a", '#include <vector>\n #include "a.h"\n')], "path string, content string"))
    assert rows(inc, "included", "system") == [("a.h", False), ("vector", True)]
    (tmp_path / "cc.json").write_text('[{"directory": "/", "command": "cc -c a.cpp -o a.o", "file": "a.cpp"}, {"directory": "/", "command": "cc -c a.cpp -o a.o", "file": "a.cpp"}, {"directory": "/", "command": "x y.txt", "file": "y.txt"}]')
    (r,) = files.build_actions(spark, str(tmp_path / "cc.json")).collect()
    assert (r["type"], r["sources"], r["targets"]) == ("Compile", ["a.cpp"], ["a.o"])
    assert files.inputs_and_outputs("ld a.o b.o -o app") == (["a.o", "b.o"], ["app"], "Link")


def test_fnv1a_and_plain_text(spark):
    from srclake.functions import expr
    from srclake.sources import files

    def fnv(x):
        h = 0xCBF29CE484222325
        for b in x.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h - (1 << 64) if h >> 63 else h

    texts = ["", "a", "/src/é.cpp", "x" * 500, None, "b"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", expr.fnv1a("x").alias("h")).collect()
    assert {r["i"]: r["h"] for r in got} == {i: None if x is None else fnv(x) for i, x in enumerate(texts)}
    assert spark.createDataFrame([(None,)], "x string").select(expr.fnv1a("x").alias("h")).collect()[0]["h"] is None
    raw = [b"plain", b"P\x05\x00", b"\x50\x0a", b"\x00", b"\xff\xfe", b"", "é".encode()]
    plain = spark.createDataFrame([(bytearray(x),) for x in raw], "c binary").select(files.is_plain_text(F.col("c")).alias("p")).collect()
    assert [r["p"] for r in plain] == [True, False, True, False, False, True, True]


def test_topological_levels_with_cycles(spark):
    import random

    from srclake.operators import graph

    rng = random.Random(1)
    edges = {(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(35)) if a != b} | {(40, 41), (41, 40), (0, 40)}
    nodes = {x for e in edges for x in e} | {99}
    want, live, left, level = {}, set(edges), set(nodes), 0
    while left:
        free = {n for n in left if all(b != n for _, b in live)} or set(left)
        want |= dict.fromkeys(free, level)
        left, live, level = left - free, {(a, b) for a, b in live if a not in free}, level + 1
    got = graph.topological_levels(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(list(edges), "src long, dst long"))
    assert {r["id"]: r["level"] for r in got.collect()} == want


def test_log_search(spark):
    from srclake.operators import index, search

    d = spark.createDataFrame([(1, "x error here\nat disk full"), (2, "error"), (3, None)], "doc_id long, text string")
    assert search.log_query("Error: disk full, error") == ["error", "disk", "full", "error"] and search.log_query("one!") == []
    got = index.log_search(d, "error disk full", text="text").collect()
    assert {(r["doc_id"], r["first_line"], r["first_col"], r["last_line"], r["last_col"]) for r in got} == {(1, 1, 3, 2, 13)}
    assert index.log_search(d, "error", text="text").count() == 0


def test_incremental_run(spark):
    from srclake.operators import maintenance

    files = spark.createDataFrame([(i, f"/f{i}") for i in range(40)], "file_id long, path string")
    old = spark.createDataFrame([(f"/f{i}", "a") for i in range(30)], "path string, hash string")
    new = spark.createDataFrame([(f"/f{i}", "b" if i == 3 else "a") for i in range(1, 31)], "path string, hash string")  # 0 deleted, 3 changed, 30 added
    includes = spark.createDataFrame([(5, 3), (6, 5), (7, 8)], "includer long, included long")
    facts = {"loc": spark.createDataFrame([(i, "old") for i in range(30)], "file_id long, what string"), "log": spark.createDataFrame([(3, "x"), (9, "x")], "file_id long, what string")}
    parse = lambda f: {"loc": f.select("file_id", F.lit("new").alias("what"))}
    out, report = maintenance.incremental_run(facts, files, old, new, includes, parse)
    assert report == {"changed": 2, "total": 30, "full": False}
    loc = {r["file_id"]: r["what"] for r in out["loc"].collect()}
    assert set(loc) == set(range(1, 31)) and {i for i, w in loc.items() if w == "new"} == {3, 5, 6, 30}
    assert [r["file_id"] for r in out["log"].collect()] == [9]
    out, report = maintenance.incremental_run(facts, files, old, new, includes, parse, percent=5)
    assert report["full"] and {r["what"] for r in out["loc"].collect()} == {"new"} and out["log"].count() == 0
