"""Reference navigation over C++ facts (RF*), set-based: any number of queried nodes in one plan.

`facts` is a dict of fact tables (store.SCHEMAS).  Every operator returns the queried node as `query_id` and the result
rows of ast_node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from . import graph, metrics, ranges

NODE = ["id", "entity_hash", "ast_value", "symbol_type", "ast_type", "visible", "file_id", "start_line", "start_col", "end_line", "end_col"]


class Navigation:
    def __init__(self, facts: dict[str, DataFrame]):
        self.f = facts
        self.nodes = facts["ast_node"]

    # -- selectors

    def _chosen(self, ids: list[int] | DataFrame) -> DataFrame:
        """Nodes by id: a list, or a table with a column id."""
        return self.nodes.join(ids.select("id").distinct(), "id", "left_semi") if isinstance(ids, DataFrame) else self.nodes.where(F.col("id").isin(*ids))

    def _queried(self, ids: list[int] | DataFrame) -> DataFrame:
        return self._chosen(ids).select(F.col("id").alias("query_id"), F.col("entity_hash").alias("q_hash"))

    def _same_entity(self, ids: list[int], cond: Column | None = None, known_end: bool = True) -> DataFrame:
        """N(node, P): nodes of the same entity with a known end and P."""
        n = self.nodes if cond is None else self.nodes.where(cond)
        n = n.where("end_line IS NOT NULL") if known_end else n
        return self._queried(ids).join(n, F.col("q_hash") == F.col("entity_hash")).select("query_id", *NODE)

    def _definitions_of(self, hashes: DataFrame, known_end: bool = True) -> DataFrame:
        """Definition nodes of (query_id, q_hash) rows."""
        n = self.nodes.where("ast_type = 'Definition'")
        n = n.where("end_line IS NOT NULL") if known_end else n
        return hashes.select("query_id", "q_hash").join(n, F.col("q_hash") == F.col("entity_hash")).select("query_id", *NODE)

    def definition(self, ids):
        """RF1."""
        return self._same_entity(ids, F.col("ast_type") == "Definition")

    def declaration(self, ids):
        """RF2."""
        return self._same_entity(ids, (F.col("ast_type") == "Declaration") & F.col("visible"))

    def usage(self, ids):
        """RF3: every occurrence."""
        return self._same_entity(ids)

    def _first_definition(self, ids) -> DataFrame:
        return self.definition(ids).groupBy("query_id").agg(F.min_by(F.struct(*NODE), "id").alias("d")).select("query_id", "d.*")

    def this_calls(self, ids):
        """RF4: function usages within the first definition (JN6)."""
        calls = self.nodes.where("symbol_type = 'Function' AND ast_type IN ('Usage', 'VirtualCall')")
        return ranges.within(calls, self._first_definition(ids)).where("inner.id <> outer.id").select(F.col("outer.query_id").alias("query_id"), *(F.col(f"inner.{c}").alias(c) for c in NODE))

    def calls_of_this(self, ids):
        """RF5."""
        return self._same_entity(ids, F.col("ast_type") == "Usage")

    def callee(self, ids):
        """RF6: definitions of what RF4 calls, each once."""
        return self._definitions_of(self.this_calls(ids).select("query_id", F.col("entity_hash").alias("q_hash")).distinct()).dropDuplicates(["query_id", "id"])

    def caller(self, ids):
        """RF7: function definitions around usages (JN7), each once."""
        scopes = self.nodes.where("symbol_type = 'Function' AND ast_type = 'Definition'")
        x = ranges.enclosing(self.calls_of_this(ids), scopes)
        return x.select(F.col("inner.query_id").alias("query_id"), *(F.col(f"outer.{c}").alias(c) for c in NODE)).dropDuplicates(["query_id", "id"])

    def _related(self, ids, kind: str, reverse: bool) -> DataFrame:
        """(query_id, q_hash) of the closure of a relation kind."""
        rel = self.f["relation"].where(F.col("kind") == kind)
        q = self._queried(ids)
        c = graph.closure(rel, q.select(F.col("q_hash").alias("start")).distinct(), reverse, "lhs", "rhs")
        return q.join(c, F.col("q_hash") == F.col("start")).select("query_id", F.col("node").alias("q_hash"))

    def virtual_call(self, ids):
        """RF8: virtual calls of the function and of all it overrides."""
        calls = self.nodes.where("ast_type = 'VirtualCall' AND end_line IS NOT NULL")
        over = self._related(ids, "Override", False)
        both = over.unionByName(self._queried(ids))
        return both.join(calls, F.col("q_hash") == F.col("entity_hash")).select("query_id", *NODE).dropDuplicates(["query_id", "id"])

    def virtual_call_count(self, ids):
        """RF8's count, repeats included (Q5)."""
        calls = self.nodes.where("ast_type = 'VirtualCall' AND end_line IS NOT NULL")
        both = self._related(ids, "Override", False).unionByName(self._queried(ids))
        return both.join(calls, F.col("q_hash") == F.col("entity_hash")).groupBy("query_id").agg(F.count("id").alias("n"))

    def func_ptr_call(self, ids):
        """RF9: usages of all that the Assign relation reaches, repeats kept."""
        use = self.nodes.where("ast_type = 'Usage'")
        both = self._related(ids, "Assign", False).unionByName(self._queried(ids))
        return both.join(use, F.col("q_hash") == F.col("entity_hash")).select("query_id", *NODE)

    def _ordered(self, ids, table: str, column: str) -> DataFrame:
        t = self.f[table].groupBy("entity_hash").agg(F.min_by(column, "ast_node_id").alias("xs"))
        x = self._queried(ids).join(t, F.col("q_hash") == F.col("entity_hash")).select("query_id", F.posexplode("xs").alias("ordinal", "m"))
        return x.join(self.nodes, F.col("m") == F.col("id")).select("query_id", "ordinal", *NODE).orderBy("query_id", "ordinal")

    def parameter(self, ids):
        """RF10, in declared order."""
        return self._ordered(ids, "function", "parameters")

    def local_var(self, ids):
        """RF11."""
        return self._ordered(ids, "function", "locals")

    def _via(self, ids, table: DataFrame, key: str, value: str, definitions: bool = True) -> DataFrame:
        """JN13: entity -> related entity -> its definitions."""
        rel = table.select(F.col(key).alias("k"), F.col(value).alias("v"))
        hop = self._queried(ids).join(rel, F.col("q_hash") == F.col("k")).select("query_id", F.col("v").alias("q_hash"))
        return self._definitions_of(hop.distinct() if definitions else hop)

    def return_type(self, ids):
        """RF12."""
        return self._via(ids, self.f["function"], "entity_hash", "type_hash")

    def overrides(self, ids):
        """RF13: one node (of smallest id, Q8) for each function that this overrides."""
        return self._one_each(self._related(ids, "Override", False))

    def overridden_by(self, ids):
        """RF14."""
        return self._one_each(self._related(ids, "Override", True))

    def _one_each(self, hashes: DataFrame) -> DataFrame:
        first = metrics.first_definition(self.nodes)
        return hashes.join(first, F.col("q_hash") == F.col("entity_hash")).select("query_id", *NODE)

    def read(self, ids):
        """RF15."""
        return self._same_entity(ids, F.col("ast_type") == "Read")

    def write(self, ids):
        """RF15."""
        return self._same_entity(ids, F.col("ast_type") == "Write")

    def type(self, ids):
        """RF16."""
        return self._via(ids, self.f["typed_entity"].where("kind = 'Variable'"), "entity_hash", "type_hash")

    def alias(self, ids):
        """RF17: typedefs of the type."""
        t = self.f["typed_entity"].where("kind = 'Typedef'").select("ast_node_id", "type_hash")
        return self._queried(ids).join(t, F.col("q_hash") == F.col("type_hash")).join(self.nodes, F.col("ast_node_id") == F.col("id")).select("query_id", *NODE)

    def inherit_from(self, ids):
        """RF18."""
        return self._via(ids, self.f["inheritance"], "derived", "base")

    def inherit_by(self, ids):
        """RF18."""
        return self._via(ids, self.f["inheritance"], "base", "derived")

    def inherit_from_count(self, ids):
        """RF18's count: inheritance rows (Q5)."""
        return self._queried(ids).join(self.f["inheritance"], F.col("q_hash") == F.col("derived")).groupBy("query_id").agg(F.count("*").alias("n"))

    def _members(self, ids, kind: str) -> DataFrame:
        m = self.f["member_type"].where(F.col("kind") == kind).select("type_hash", "member_ast_node")
        return self._queried(ids).join(m, F.col("q_hash") == F.col("type_hash")).join(self.nodes, F.col("member_ast_node") == F.col("id")).select("query_id", *NODE).dropDuplicates(["query_id", "id"])

    def data_member(self, ids):
        """RF19: with a known end."""
        return self._members(ids, "Field").where("end_line IS NOT NULL")

    def data_member_count(self, ids):
        """RF19's count, without the end filter (Q5)."""
        return self._members(ids, "Field").groupBy("query_id").agg(F.count("*").alias("n"))

    def method(self, ids):
        """RF20."""
        return self._members(ids, "Method")

    def friend(self, ids):
        """RF21."""
        return self._via(ids, self.f["friendship"], "target", "the_friend")

    def underlying_type(self, ids):
        """RF22."""
        return self._via(ids, self.f["typed_entity"].where("kind = 'Typedef'"), "entity_hash", "type_hash")

    def enum_constants(self, ids):
        """RF23, in declared order."""
        return self._ordered(ids, "enumeration", "constants")

    def expansion(self, ids):
        """RF24: the node with its expansion as value."""
        e = self.f["macro_expansion"]
        n = self._chosen(ids)
        return n.join(e, F.col("id") == F.col("ast_node_id")).select(F.col("id").alias("query_id"), *(F.col("expansion").alias(c) if c == "ast_value" else F.col(c) for c in NODE))

    def undefinition(self, ids):
        """RF25."""
        return self._same_entity(ids, F.col("ast_type") == "UnDefinition")

    def file_references(self, file_id: int, kind: str) -> DataFrame:
        """RF26: types, functions, includes or macros of a file, by value."""
        n = self.nodes.where(F.col("file_id") == file_id)
        sets = {"types": "symbol_type = 'Type' AND ast_type = 'Definition'", "functions": "symbol_type = 'Function' AND ast_type = 'Definition'", "macros": "symbol_type = 'Macro'", "includes": "symbol_type = 'File' AND ast_type = 'Usage'"}
        return n.where(sets[kind]).orderBy("ast_value", "id")

    def counts(self, rows: DataFrame) -> DataFrame:
        """AG1: rows of each queried node."""
        return rows.groupBy("query_id").agg(F.count("id").alias("n"))

    def tags(self, ids) -> DataFrame:
        """RF27: visibility as a member, then the entity's tags, in order."""
        vis = self.nodes.select("id", "entity_hash").join(self.f["member_type"].select(F.col("member_ast_node").alias("id"), "visibility"), "id").select("entity_hash", F.col("visibility").alias("tag"), F.lit(0).alias("o"))
        own = self.f["function"].select("entity_hash", F.posexplode("tags").alias("o", "tag")).select("entity_hash", "tag", (F.col("o") + 1).alias("o"))
        t = vis.unionByName(own).distinct().groupBy("entity_hash").agg(F.array_sort(F.collect_set(F.struct("o", "tag"))).alias("ts"))
        return self._queried(ids).join(t, F.col("q_hash") == F.col("entity_hash")).select("query_id", F.transform("ts", lambda x: x["tag"]).alias("tags"))

    def _described(self, variables_only: bool = False) -> DataFrame:
        """(entity_hash, symbol_type, properties) of every entity; of its rows the one of the smallest node counts.  Columns
        that a fact table doesn't have, and nulls, give no property."""

        def of(table: str, symbol: str, props: dict[str, Column | str], rows: DataFrame | None = None) -> DataFrame:
            t = self.f[table] if rows is None else rows
            have = [x for k, v in props.items() if not isinstance(v, str) or v in t.columns for x in (F.lit(k), F.col(v).cast("string") if isinstance(v, str) else v)]
            whole = F.map_filter(F.create_map(F.lit("Kind"), F.lit(symbol), *have), lambda k, v: v.isNotNull())
            first = [c for c in ("ast_node_id", "qualified_name") if c in t.columns]
            return t.groupBy("entity_hash").agg(F.min_by(whole, F.struct(*first)).alias("properties")).select("entity_hash", F.lit(symbol).alias("symbol_type"), "properties")

        last = F.element_at(F.split("qualified_name", "::"), -1)
        name = lambda t: F.col("name") if "name" in self.f[t].columns else last
        flag = lambda t, c: F.when(F.col(c), "true") if c in self.f[t].columns else F.lit(None).cast("string")
        typed, record = self.f["typed_entity"], self.f["record"]
        types = record.groupBy(F.col("entity_hash").alias("type_hash")).agg(F.min("qualified_name").alias("_type"))
        variable = typed.where("kind = 'Variable'").join(types, "type_hash", "left")
        type_ = F.coalesce("qualified_type", "_type") if "qualified_type" in typed.columns else F.col("_type")
        out = of("typed_entity", "Variable", {"Name": name("typed_entity"), "Qualified name": "qualified_name", "Type": type_}, variable)
        if variables_only:
            return out
        out = out.unionByName(of("typed_entity", "Typedef", {"Name": name("typed_entity"), "Qualified name": "qualified_name"}, typed.where("kind = 'Typedef'")))
        out = out.unionByName(of("function", "Function", {"Name": last, "Qualified name": "qualified_name", "Signature": "name"}))
        marks = {"Abstract type": flag("record", "is_abstract"), "POD type": flag("record", "is_pod"), "Lambda": flag("record", "is_lambda")}
        out = out.unionByName(of("record", "Type", marks | {"Name": name("record"), "Qualified name": "qualified_name", "Context": "context"}))
        if "enum_constant" in self.f:
            out = out.unionByName(of("enum_constant", "EnumConstant", {"Name": name("enum_constant"), "Qualified name": "qualified_name", "Value": "value"}))
        return out

    def properties(self, ids) -> DataFrame:
        """RF28: a map by the node's kind of symbol: functions have a signature, variables a type, types their marks and
        context, enum constants a value.  Nodes of other kinds, and entities without facts, have no row."""
        q = self._chosen(ids).select(F.col("id").alias("query_id"), "entity_hash", "symbol_type")
        return q.join(self._described(), ["entity_hash", "symbol_type"]).select("query_id", "properties")

    def source_text(self, ids) -> DataFrame:
        """RF29: text of the node's range (FN3)."""
        files = self.f["file"].select(F.col("id").alias("file_id"), "content_hash").join(self.f["file_content"].select(F.col("hash").alias("content_hash"), "content"), "content_hash")
        n = self._chosen(ids).join(files, "file_id")
        return n.select(F.col("id").alias("query_id"), expr.text_range("content", "start_line", "start_col", "end_line", "end_col").alias("text"))

    def documentation(self, ids) -> DataFrame:
        """RF29: own comment and those of methods, in order of name."""
        d = self.f["doc_comment"].select("entity_hash", "content")
        own = self._queried(ids).join(d, F.col("q_hash") == F.col("entity_hash")).select("query_id", F.lit("").alias("k"), "content")
        m = self.method(ids).select("query_id", "entity_hash", F.col("ast_value").alias("k")).join(d, "entity_hash").select("query_id", "k", F.concat_ws("\n", expr.html_escape("k"), "content").alias("content"))
        return own.unionByName(m).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "content"))), lambda x: x["content"]), "\n").alias("documentation"))

    def highlight(self, ids, word: str) -> DataFrame:
        """RF30: places of the word on the lines of the nodes."""
        files = self.f["file"].select(F.col("id").alias("file_id"), "content_hash").join(self.f["file_content"].select(F.col("hash").alias("content_hash"), "content"), "content_hash")
        n = self.usage(ids).select("query_id", "file_id", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct().join(files, "file_id")
        return n.select("query_id", "file_id", "line", F.explode(expr.word_places(F.element_at(F.split("content", "\n"), F.col("line")), word)).alias("start_col")).withColumn("end_col", F.col("start_col") + len(word))

    def node_at(self, file_id: int, line: int, col: int) -> DataFrame:
        """RF31, JN9."""
        p = self.nodes.sparkSession.createDataFrame([(0, file_id, line, col)], "point_id long, file_id long, line int, col int")
        return ranges.innermost(p, self.nodes.withColumn("is_macro", F.col("symbol_type") == "Macro"), macro="is_macro")

    def node(self, ast_node_id: int) -> DataFrame:
        """RF31, PRD11: an error if there is none."""
        out = self.nodes.where(F.col("id") == ast_node_id).limit(1)
        if out.isEmpty():
            raise LookupError(f"no node {ast_node_id}")
        return out

    def references(self, ids, kind: str, in_file: int | None = None, page: tuple[int, int] | None = None) -> DataFrame:
        """Rows of one kind, sorted by value unless order is declared (SO1); in a file or a page of ids (RF32)."""
        rows = getattr(self, kind)(ids)
        if in_file is not None:
            rows = rows.where(F.col("file_id") == in_file)
        if page is not None:
            size, previous = page
            return metrics.page_rows(rows, rows, "id", size, previous)
        return rows if kind in ("parameter", "local_var", "enum_constants") else rows.orderBy("ast_value", "id")

    # -- diagrams

    def function_call_diagram(self, ids) -> graph.Graph:
        """GR21: definition -> callees and callers -> definition, each pair once."""
        out = self.callee(ids).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.lit("calls").alias("type"))
        into = self.caller(ids).select(F.col("id").alias("src"), F.col("query_id").alias("dst"), F.lit("calls").alias("type"))
        return graph.Graph.of(out.unionByName(into).distinct())

    def class_diagram(self, ids) -> graph.Graph:
        """GR22: a class, its bases and derived classes, each node labelled with its members; edges go to the base.  A class
        without either is a node alone."""
        up = self.inherit_from(ids).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.lit("inherits").alias("type"))
        down = self.inherit_by(ids).select(F.col("id").alias("src"), F.col("query_id").alias("dst"), F.lit("inherits").alias("type"))
        g = graph.Graph.of(up.unionByName(down).distinct())
        shown = g.nodes.select("id").unionByName(self._chosen(ids).select("id")).distinct()
        attrs = F.create_map(F.lit("label"), F.col("html"), F.lit("shape"), F.lit("none"))
        return graph.Graph(self.class_members_html(shown).select(F.col("query_id").alias("id"), attrs.alias("attrs")), g.edges)

    def class_members_html(self, ids) -> DataFrame:
        """GR22: each class as a table: its name, then its data members with their types, then its methods with a name; a
        sign for the visibility, static members in bold, virtual ones in italics."""
        data = self.data_member(ids).select("query_id", F.lit(0).alias("o"), "id", "ast_value")
        m = data.unionByName(self.method(ids).where("ast_value <> ''").select("query_id", F.lit(1).alias("o"), "id", "ast_value"))
        of = m.select("id").distinct()
        tags = self.tags(of).select(F.col("query_id").alias("id"), "tags")
        named = self._chosen(of).select("id", "entity_hash", "symbol_type").join(self._described(variables_only=True), ["entity_hash", "symbol_type"])
        m = m.join(tags, "id", "left").join(named.select("id", F.col("properties")["Type"].alias("type")), "id", "left")
        has = lambda tag: F.coalesce(F.array_contains("tags", tag), F.lit(False))
        marked = lambda cond, tag, c: F.when(cond, F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))).otherwise(c)
        sign = F.when(has("public"), "+").when(has("private"), "-").when(has("protected"), "#").otherwise("")
        text = expr.html_escape(F.concat("ast_value", F.when((F.col("o") == 0) & F.col("type").isNotNull(), F.concat(F.lit(" : "), "type")).otherwise("")))
        row = F.concat(F.lit("<tr><td>"), sign, F.lit("</td><td>"), marked(has("static"), "b", marked(has("virtual"), "i", text)), F.lit("</td></tr>"))
        rows = m.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("o", "ast_value", "id", row.alias("r")))).alias("rs"))
        head = self._chosen(ids).select(F.col("id").alias("query_id"), F.concat(F.lit("<table><tr><td colspan='2'>"), expr.html_escape("ast_value"), F.lit("</td></tr>")).alias("head"))
        body = F.coalesce(F.array_join(F.transform("rs", lambda x: x["r"]), ""), F.lit(""))
        return head.join(rows, "query_id", "left").select("query_id", F.concat("head", body, F.lit("</table>")).alias("html"))

    def collaboration_diagram(self, ids) -> DataFrame:
        """GR23: class -> types of its data members; parallel edges merged, member names joined by ', '."""
        m = self.data_member(ids).select("query_id", "entity_hash", "ast_value")
        t = self.f["typed_entity"].where("kind = 'Variable'").select("entity_hash", "type_hash")
        hop = m.join(t, "entity_hash").select("query_id", F.col("type_hash").alias("q_hash"), "ast_value").distinct()
        d = self.nodes.where("ast_type = 'Definition'").select("entity_hash", "id")
        return graph.merged_edges(hop.join(d, F.col("q_hash") == F.col("entity_hash")).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "ast_value"), "ast_value")
