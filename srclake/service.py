"""Services: one class for each, whose methods return DataFrames (SV1-SV3), and a registry of operators (UDF)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import expr
from .operators import history, metrics, paths, search
from .operators.nav import Navigation
from .operators.nav_py import PythonNavigation
from .sources import files

_OPERATORS: dict[str, Callable] = {}


def operator(name: str):
    """Registers a user's operator under a name: the extension point."""

    def add(f):
        _OPERATORS[name] = f
        return f

    return add


def operators() -> dict[str, Callable]:
    return dict(_OPERATORS)


class ProjectTree:
    """SV1 over file, file_content, build_log and statistics."""

    def __init__(self, facts: dict[str, DataFrame]):
        self.f = facts

    def file_by_id(self, file_id: int) -> DataFrame:
        out = self.f["file"].where(F.col("id") == file_id).limit(1)
        if out.isEmpty():
            raise LookupError(f"no file {file_id}")
        return out

    def file_by_path(self, path: str) -> DataFrame:
        out = self.f["file"].where(F.col("path") == path).limit(1)
        if out.isEmpty():
            raise LookupError(f"no file {path}")
        return out

    def parent(self, file_id: int) -> DataFrame:
        """The directory of a file; an error if the file has none."""
        return self.file_by_id(self.file_by_id(file_id).first()["parent_id"])

    def content(self, file_id: int) -> DataFrame:
        return self.file_by_id(file_id).join(self.f["file_content"], F.col("hash") == F.col("content_hash")).select("content")

    def build_log(self, file_id: int) -> DataFrame:
        return self.f["build_log"].where(F.col("file_id") == file_id)

    def file_types(self) -> DataFrame:
        return self.f["file"].select("type").distinct().orderBy("type")

    def statistics(self) -> DataFrame:
        return metrics.with_summary(self.f["statistics"])

    def children(self, file_id: int) -> DataFrame:
        return self.f["file"].where(F.col("parent_id") == file_id).orderBy(F.desc(F.col("type") == "Dir"), "filename")

    def roots(self) -> DataFrame:
        return self.f["file"].where("parent_id IS NULL").orderBy(F.desc(F.col("type") == "Dir"), "filename")

    def subtree(self, path: str) -> DataFrame:
        return paths.subtree(self.f["file"], path)

    def open_tree(self, file_id: int) -> DataFrame:
        """The entries of every directory on the way to the file."""
        return paths.open_tree(self.f["file"], self.file_by_id(file_id).first()["path"])

    def path_to_root(self, file_id: int) -> DataFrame:
        """The file and its directories, root last."""
        return paths.path_to_root(self.f["file"], self.file_by_id(file_id).first()["path"])

    def search(self, part: str, only_files: bool = False) -> DataFrame:
        out = search.files_by_substring(self.f["file"], part)
        return out.where("type <> 'Dir'") if only_files else out

    def labels(self) -> DataFrame:
        """label, path of the project's metadata (facts["project"], SNK6)."""
        return files.labels(self.f["project"])


class Metrics:
    """MT16 over ast_metric, module_metric, ast_node and file.  Pages hold the next `size` nodes or files after `previous`."""

    #: Types of metrics and their names.
    NODE_TYPES = {1: "Number of function parameters", 2: "Cyclomatic (McCabe) complexity of function", 3: "Cyclomatic (McCabe) complexity of type", 4: "Bumpy road complexity of function", 5: "Lack of cohesion of type", 6: "Lack of cohesion of type (Henderson-Sellers variant)", 7: "Efferent coupling of type", 8: "Afferent coupling of type"}
    MODULE_TYPES = {1: "Efferent coupling of module", 2: "Afferent coupling of module", 3: "Relational cohesion of module"}

    def __init__(self, facts: dict[str, DataFrame]):
        self.f = facts

    def single(self, node: int, kind: int) -> float:
        return metrics.single(self.f["ast_metric"], node, kind)

    def of_node(self, node: int) -> DataFrame:
        return self.f["ast_metric"].where(F.col("ast_node_id") == node).select("type", "value").orderBy("type")

    def of_module(self, file_id: int) -> DataFrame:
        return self.f["module_metric"].where(F.col("file_id") == file_id).select("type", "value").orderBy("type")

    def nodes(self, path: str, size: int | None = None, previous: int | None = None) -> DataFrame:
        return metrics.node_entries(self.f["ast_metric"], self.f["ast_node"], self.f["file"], path, size, previous).orderBy("ast_node_id")

    def details(self, path: str, size: int | None = None, previous: int | None = None) -> DataFrame:
        return metrics.node_details(self.f["ast_metric"], self.f["ast_node"], self.f["file"], path, size, previous).orderBy("ast_node_id")

    def modules(self, path: str, size: int | None = None, previous: int | None = None) -> DataFrame:
        return metrics.module_entries(self.f["module_metric"], self.f["file"], path, size, previous).orderBy("file_id")

    def node_types(self) -> DataFrame:
        return self.f["ast_metric"].sparkSession.createDataFrame(list(self.NODE_TYPES.items()), "type int, name string")

    def module_types(self) -> DataFrame:
        return self.f["module_metric"].sparkSession.createDataFrame(list(self.MODULE_TYPES.items()), "type int, name string")


class Workspaces:
    """SV2, SO10: workspaces of a listing (id, description)."""

    def __init__(self, listing: DataFrame):
        self.listing = listing

    def all(self) -> DataFrame:
        return self.listing.orderBy("id")


class Plugins:
    """SV2: the registered operators, by name."""

    @staticmethod
    def all() -> list[str]:
        return sorted(_OPERATORS)


class History:
    def __init__(self, commits: DataFrame):
        self.commits = commits

    def log(self, oid: str | None, count: int, offset: int = 0, text: str | None = None, compat: bool = False) -> DataFrame:
        c = self.commits if oid is None else history.ancestors_of(self.commits, oid)
        return history.log(c, count, offset, text, compat)


class Editor:
    """SV3: editor-protocol methods as calls of the navigation services."""

    METHODS = {"textDocument/definition": "definition", "textDocument/declaration": "declaration", "textDocument/references": "usage", "textDocument/implementation": "overridden_by", "textDocument/typeDefinition": "type", "callHierarchy/incomingCalls": "caller", "callHierarchy/outgoingCalls": "callee", "typeHierarchy/supertypes": "inherit_from", "typeHierarchy/subtypes": "inherit_by", "srclake/parameters": "parameter", "srclake/localVariables": "local_var", "srclake/read": "read", "srclake/write": "write", "srclake/members": "data_member", "srclake/methods": "method", "srclake/friends": "friend"}

    def __init__(self, navigation: Navigation | PythonNavigation):
        self.navigation = navigation

    def call(self, method: str, file_id: int, line: int, col: int) -> DataFrame:
        if method not in self.METHODS:
            raise LookupError(f"unknown method {method}")
        ids = [r["id"] for r in self.navigation.node_at(file_id, line, col).select("id").collect()]
        return getattr(self.navigation, self.METHODS[method])(ids)


def register_views(facts: dict[str, DataFrame]) -> None:
    """Temp views of the fact tables, for Spark SQL."""
    for name, df in facts.items():
        df.createOrReplaceTempView(name)


__all__ = ["Editor", "History", "Metrics", "Navigation", "ProjectTree", "PythonNavigation", "Workspaces", "expr", "operator", "operators", "register_views"]
