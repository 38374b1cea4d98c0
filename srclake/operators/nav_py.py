"""Reference navigation over Python names (PY*, GR24-GR26), set-based."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from . import graph, ranges


class PythonNavigation:
    def __init__(self, names: DataFrame, contents: DataFrame | None = None):
        """names: py_name; contents: file_id, content."""
        self.names, self.contents = names, contents

    def _chosen(self, ids) -> DataFrame:
        """Names by id: a list, or a table with a column id."""
        return self.names.join(ids.select("id").distinct(), "id", "left_semi") if isinstance(ids, DataFrame) else self.names.where(F.col("id").isin(*ids))

    def _queried(self, ids) -> DataFrame:
        return self._chosen(ids).select(*(F.col(c).alias(f"n_{c}") for c in ("id", "ref_id", "parent", "parent_function")))

    def _rows(self, ids, on: str, cond: str = "true") -> DataFrame:
        x = self._queried(ids).join(self.names, F.expr(on)).where(cond)
        return x.select(F.col("n_id").alias("query_id"), *self.names.columns).orderBy("line_start", "column_start")

    def definition(self, ids):
        """PY1."""
        return self._rows(ids, "ref_id = n_ref_id", "is_definition AND NOT is_import")

    def usage(self, ids):
        """PY2."""
        return self._rows(ids, "ref_id = n_ref_id AND id <> n_id", "NOT is_definition")

    def method(self, ids):
        """PY3."""
        return self._rows(ids, "parent = n_ref_id", "type = 'function' AND is_definition")

    def local_var(self, ids):
        """PY4."""
        return self._rows(ids, "parent = n_ref_id", "type = 'statement' AND is_definition")

    data_member = local_var

    def parent(self, ids):
        """PY5."""
        return self._rows(ids, "id = n_parent")

    def parent_function(self, ids):
        """PY5."""
        return self._rows(ids, "id = n_parent_function")

    def parameter(self, ids):
        """PY6."""
        return self._rows(ids, "parent = n_ref_id", "type = 'astparam' AND is_definition")

    def caller(self, ids):
        """PY7."""
        return self._rows(ids, "ref_id = n_ref_id AND id <> n_id", "is_call AND NOT is_definition")

    def this_calls(self, ids):
        """PY8."""
        return self._rows(ids, "parent = n_id", "is_call")

    def annotation(self, ids):
        """PY9."""
        return self._rows(ids, "parent = n_id", "type = 'annotation'")

    def base_class(self, ids):
        """PY10: definitions of what the class names as bases."""
        bases = self._queried(ids).join(self.names.where("type = 'baseclass'").select("parent", F.col("ref_id").alias("b")), F.expr("parent = n_id")).select("n_id", "b").distinct()
        d = self.names.where("is_definition AND NOT is_import")
        return bases.join(d, F.expr("ref_id = b")).select(F.col("n_id").alias("query_id"), *self.names.columns).orderBy("line_start", "column_start")

    def in_file(self, file_id: int, definitions: bool = False):
        """PY11, PY13: by (is_builtin, line, column)."""
        n = self.names.where(F.col("file_id") == file_id)
        n = n.where("is_definition AND NOT is_import") if definitions else n
        return n.orderBy("is_builtin", "line_start", "column_start")

    def node_at(self, file_id: int, line: int, col: int) -> DataFrame:
        """PY12, JN10."""
        p = self.names.sparkSession.createDataFrame([(0, file_id, line, col)], "point_id long, file_id long, line int, col int")
        return ranges.shortest_at(p, self.names)

    def properties(self, ids) -> DataFrame:
        """PY12."""
        s = lambda c: F.col(c).cast("string")
        m = F.create_map(F.lit("Full name"), F.col("full_name"), F.lit("Builtin"), s("is_builtin"), F.lit("Function call"), s("is_call"), F.lit("Type hint"), F.coalesce("type_hint", F.lit("")))
        return self._chosen(ids).select(F.col("id").alias("query_id"), m.alias("properties"))

    def source_text(self, ids) -> DataFrame:
        """PY12."""
        n = self._chosen(ids).join(self.contents, "file_id")
        return n.select(F.col("id").alias("query_id"), expr.text_range("content", "line_start", "column_start", "line_end", "column_end").alias("text"))

    def line_text(self, file_id: int, line: int) -> DataFrame:
        """PY12."""
        return self.contents.where(F.col("file_id") == file_id).select(F.element_at(F.split("content", "\n"), line).alias("text"))

    def call_diagram(self, ids) -> graph.Graph:
        """GR24: name -> definitions of its calls (unresolved calls themselves), callers -> name."""
        calls = self.this_calls(ids).select("query_id", "id", "ref_id")
        d = self.names.where("is_definition AND NOT is_import").select(F.col("ref_id").alias("r"), F.col("id").alias("d"))
        out = calls.join(d, F.expr("ref_id = r"), "left").select(F.col("query_id").alias("src"), F.coalesce("d", "id").alias("dst"), F.lit("calls").alias("type"))
        into = self.caller(ids).select(F.coalesce("parent_function", "parent").alias("src"), F.col("query_id").alias("dst"), F.lit("calls").alias("type"))
        return graph.Graph.of(out.unionByName(into).distinct())

    def module_diagram(self, file_id: int) -> DataFrame:
        """GR25: edges between files: this file -> files whose definitions it imports, users -> this file; placeholder
        rows at (0, 0, 1, 1) don't count."""
        real = self.names.where("NOT (line_start = 0 AND line_end = 0 AND column_start = 1 AND column_end = 1)")
        d = real.where("is_definition AND NOT is_import").select("ref_id", F.col("file_id").alias("def_file")).distinct()
        u = real.where("NOT is_definition OR is_import").select("ref_id", F.col("file_id").alias("use_file")).distinct()
        e = u.join(d, "ref_id").where("use_file <> def_file").select(F.col("use_file").alias("src"), F.col("def_file").alias("dst")).distinct()
        return e.where((F.col("src") == file_id) | (F.col("dst") == file_id))

    def usage_diagram(self, ids) -> graph.Graph:
        """GR26."""
        return graph.Graph.of(self.usage(ids).select(F.col("id").alias("src"), F.col("query_id").alias("dst"), F.lit("uses").alias("type")).distinct())

    def class_diagram(self, ids) -> graph.Graph:
        """GR26."""
        return graph.Graph.of(self.base_class(ids).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.lit("inherits").alias("type")).distinct())
