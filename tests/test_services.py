"""Properties, class diagrams, clusters, legends, metric and project services on small tables."""

import pytest
from pyspark.sql import functions as F

from srclake.operators import graph, loc, search
from srclake.operators.nav import Navigation
from srclake.service import Metrics, ProjectTree
from srclake.sources import files
from srclake.store import SCHEMAS

NODES = [  # id, entity, value, symbol, ast type, visible, file, start, col, end, col
    (1, 10, "Base<T>", "Type", "Definition", True, 1, 1, 1, 9, 1), (2, 20, "Derived", "Type", "Definition", True, 1, 11, 1, 19, 1),
    (3, 30, "count", "Variable", "Definition", True, 1, 2, 1, 2, 9), (4, 40, "run(int)", "Function", "Definition", True, 1, 3, 1, 5, 9),
    (5, 50, "", "Function", "Definition", True, 1, 6, 1, 6, 9), (6, 60, "RED", "EnumConstant", "Definition", True, 2, 1, 1, 1, 3),
    (7, 70, "size_type", "Typedef", "Definition", True, 2, 2, 1, 2, 3), (8, 80, "M", "Macro", "Definition", True, 2, 3, 1, 3, 3), (9, 90, "Alone", "Type", "Definition", True, 2, 4, 1, 4, 9),
]


def nav(spark):
    t = {k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()}
    t["ast_node"] = spark.createDataFrame(NODES, SCHEMAS["ast_node"])
    t["function"] = spark.createDataFrame([(4, 40, "Base::run", None, None, [], [], 1, 0, 0, False, ["virtual", "static"]), (14, 40, "other", None, None, [], [], 1, 0, 0, False, [])], SCHEMAS["function"]).withColumn("name", F.lit("void run(int)"))
    t["record"] = spark.createDataFrame([(1, 10, "ns::Base", False, "ns", []), (2, 20, "ns::Derived", True, "", []), (9, 90, "Alone", False, None, [])], SCHEMAS["record"]).withColumn("is_abstract", F.col("entity_hash") == 10)
    t["typed_entity"] = spark.createDataFrame([(3, 30, "count", "ns::Base::count", 20, "Variable"), (7, 70, "size_type", "ns::size_type", 20, "Typedef")], SCHEMAS["typed_entity"])
    t["enum_constant"] = spark.createDataFrame([(6, 60, "RED", "Colour::RED", -4)], SCHEMAS["enum_constant"])
    t["member_type"] = spark.createDataFrame([(10, 3, 20, "Field", "private"), (10, 4, None, "Method", "public"), (10, 5, None, "Method", "protected")], SCHEMAS["member_type"])
    t["inheritance"] = spark.createDataFrame([(20, 10, False, "public")], SCHEMAS["inheritance"])
    return Navigation(t)


def test_properties_by_kind(spark):
    got = {r["query_id"]: r["properties"] for r in nav(spark).properties([r[0] for r in NODES]).collect()}
    assert got == {
        1: {"Kind": "Type", "Abstract type": "true", "Name": "Base", "Qualified name": "ns::Base", "Context": "ns"},
        2: {"Kind": "Type", "Lambda": "true", "Name": "Derived", "Qualified name": "ns::Derived", "Context": ""},
        3: {"Kind": "Variable", "Name": "count", "Qualified name": "ns::Base::count", "Type": "ns::Derived"},
        4: {"Kind": "Function", "Name": "run", "Qualified name": "Base::run", "Signature": "void run(int)"},
        6: {"Kind": "EnumConstant", "Name": "RED", "Qualified name": "Colour::RED", "Value": "-4"},
        7: {"Kind": "Typedef", "Name": "size_type", "Qualified name": "ns::size_type"},
        9: {"Kind": "Type", "Name": "Alone", "Qualified name": "Alone"},
    }


def test_class_diagram_with_members(spark):
    g = nav(spark).class_diagram([2])
    assert [(r["src"], r["dst"]) for r in g.edges.collect()] == [(2, 1)]
    label = {r["id"]: r["attrs"]["label"] for r in g.nodes.collect()}
    head = "<table><tr><td colspan='2'>"
    assert label == {2: f"{head}Derived</td></tr></table>", 1: f"{head}Base&lt;T&gt;</td></tr><tr><td>-</td><td>count : ns::Derived</td></tr><tr><td>+</td><td><b><i>run(int)</i></b></td></tr></table>"}
    alone = nav(spark).class_diagram([9])
    assert [r["id"] for r in alone.nodes.collect()] == [9]
    assert alone.edges.isEmpty()


def test_clusters(spark):
    g = graph.Graph.of(spark.createDataFrame([(1, 2, "USE"), (2, 3, "USE")], "src long, dst long, type string"))
    g = g.by_directory(spark.createDataFrame([(1, "/a/b/x"), (2, "/a/y"), (4, "/z/none")], "id long, path string"))
    assert sorted(tuple(r) for r in g.members.collect()) == [("/a", 2), ("/a/b", 1)]
    assert {(r["cluster"], r["parent"]) for r in g.clusters.collect()} == {("/a", None), ("/a/b", "/a")}
    text = files.dot(g)
    assert text.split("\n") == [
        "digraph G {", '  subgraph "cluster_/a" {', '    label="a";', '    subgraph "cluster_/a/b" {', '      label="b";', '      "1";', "    }", '    "2";', "  }", '  "3";',
        '  "1" -> "2" [label="USE"];', '  "2" -> "3" [label="USE"];', "}",
    ]
    moved = g.without_cluster("/a/b").with_cluster("own", "/a").in_cluster(spark.createDataFrame([("own", 2), ("own", 3)], "cluster string, id long"))
    assert sorted(tuple(r) for r in moved.members.collect()) == [("/a", 1), ("own", 2), ("own", 3)]
    assert {(r["cluster"], r["parent"]) for r in moved.clusters.collect()} == {("/a", None), ("own", "/a")}
    top = g.without_cluster("/a").without_node(1)
    assert top.members.collect() == []
    assert [(r["cluster"], r["parent"]) for r in top.clusters.collect()] == [("/a/b", None)]


def test_legends_of_all_diagrams(spark):
    for d in {d for ds in graph.DIAGRAM_TYPES.values() for d in ds}:
        assert graph.legend(spark, d).count() >= 2
    with pytest.raises(LookupError):
        graph.legend(spark, "none")


def test_metric_services(spark):
    t = {
        "ast_node": spark.createDataFrame(NODES, SCHEMAS["ast_node"]),
        "file": spark.createDataFrame([(1, "CPP", "/s/a/x.cpp", "x.cpp", None, None, 0), (2, "CPP", "/s/ab/y.cpp", "y.cpp", None, None, 0)], SCHEMAS["file"]),
        "ast_metric": spark.createDataFrame([(4, 2, 3.0), (4, 1, 1.0), (1, 3, 7.0), (7, 1, 9.0), (99, 1, 1.0)], SCHEMAS["ast_metric"]),
        "module_metric": spark.createDataFrame([(1, 2, 5.0), (1, 1, 4.0), (2, 1, 6.0)], SCHEMAS["module_metric"]),
    }
    m = Metrics(t)
    assert m.single(4, 2) == 3.0
    with pytest.raises(LookupError):
        m.single(4, 8)
    assert [tuple(r) for r in m.of_node(4).collect()] == [(1, 1.0), (2, 3.0)]
    assert [tuple(r) for r in m.of_module(1).collect()] == [(1, 4.0), (2, 5.0)]
    entries = lambda df: [(r[0], [tuple(x) for x in r["metrics"]]) for r in df.collect()]
    x = "/s/a/x.cpp"
    assert entries(m.nodes("/s/a")) == [(1, [(x, 3, 7.0)]), (4, [(x, 1, 1.0), (x, 2, 3.0)])]
    assert entries(m.nodes("/s", 1, 1)) == [(4, [(x, 1, 1.0), (x, 2, 3.0)])]
    assert entries(m.nodes("/s", 5, 4)) == [(7, [("/s/ab/y.cpp", 1, 9.0)])]
    assert entries(m.modules("/s", 1)) == [(1, [(x, 1, 4.0), (x, 2, 5.0)])]
    (d,) = m.details("/s", 1, 1).collect()
    assert (d["path"], d["file"], d["symbol_type"], d["ast_type"], d["start_line"], d["end_line"], d["ast_value"], d["metrics"]) == ("/s/a/", "x.cpp", "Function", "Definition", 3, 5, "run(int)", {1: 1.0, 2: 3.0})
    assert m.details("/none").isEmpty()
    with pytest.raises(ValueError, match="at least one row"):
        m.nodes("/s", 0)
    assert m.node_types().count() == 8
    assert m.module_types().count() == 3


def test_project_service(spark):
    f = [(1, "Dir", "/s", "s", None, None, 0), (2, "Dir", "/s/d", "d", 1, None, 0), (3, "CPP", "/s/d/x.cpp", "x.cpp", 2, "h", 0), (4, "CPP", "/s/a.cpp", "a.cpp", 1, "h", 0)]
    p = ProjectTree({"file": spark.createDataFrame(f, SCHEMAS["file"]).withColumn("is_dir", F.col("type") == "Dir"), "project": spark.createDataFrame([({"src": "/s"}, "db", "")], "labels map<string,string>, database string, description string")})
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(p.parent(3)) == [2]
    assert ids(p.children(1)) == [2, 4]
    assert ids(p.path_to_root(3)) == [3, 2, 1]
    assert sorted(ids(p.open_tree(3))) == [1, 2, 3, 4]
    assert ids(p.roots()) == [1]
    assert [tuple(r) for r in p.labels().collect()] == [("src", "/s")]
    assert sorted(ids(p.search("/s/d"))) == [2, 3]
    assert ids(p.search("/s/d", only_files=True)) == [3]
    for missing in (lambda: p.file_by_path("/no"), lambda: p.parent(1)):
        with pytest.raises(LookupError):
            missing()


def test_loc_tree_and_its_bound(spark):
    f = spark.createDataFrame([(1, "CPP", "/s/a/x.cpp"), (2, "CPP", "/s/y.cpp"), (3, "Java", "/s/a/Z.java"), (4, "CPP", "/t/q.cpp"), (5, None, "/s/none")], "id long, type string, path string")
    m = spark.createDataFrame([(1, 1, 10), (1, 2, 8), (2, 1, 5), (3, 1, 7), (4, 1, 1), (5, 1, 1)], "id long, type int, metric int")
    got = sorted(tuple(r) for r in loc.loc_entries(m, f, "/s", ["CPP", "Java"], 1).collect())
    assert got == [("/s", "", True, 22), ("/s/a", "/s", True, 17), ("/s/a/Z.java", "/s/a", False, 7), ("/s/a/x.cpp", "/s/a", False, 10), ("/s/y.cpp", "/s", False, 5)]
    assert loc.loc_tree(m, f, "/s", ["CPP"], 1) == '{"": {"s": {"a": {"x.cpp": 10}, "y.cpp": 5}}}'
    assert loc.loc_tree(m, f, "/s", [], 1) == ""
    with pytest.raises(ValueError, match="more than 1"):
        loc.loc_tree(m, f, "/s", ["CPP"], 1, limit=1)


def test_definition_search_remembers_kinds(spark):
    tags = [(1, "Parser", "Class", 1), (1, "parse", "Function", 2), (1, "parser", "Variable", 3), (2, "parser", "Function", 1), (3, "Other", "Class", 1), (4, None, "Class", 1), (5, "parser", None, 1)]
    t = spark.createDataFrame(tags, "doc_id int, name string, kind string, line int")
    find = lambda *terms: sorted((r["doc_id"], r["line"]) for r in search.definition_search(t, list(terms)).collect())
    assert find((None, "PARSER")) == [(1, 1), (1, 3), (2, 1), (5, 1)]
    assert find(("Class", "parser")) == [(1, 1)]
    assert find(("Class", "pars*"), ("Function", "nothing")) == [(1, 1), (1, 2)]  # tags of the other kind asked for are shown too
    assert find(("Class", "p?rser"), (None, "other")) == [(1, 1), (3, 1)]
    assert find() == []
