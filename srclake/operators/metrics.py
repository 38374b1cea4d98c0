"""Metrics of functions, types and modules (MT1-MT13, MT16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from . import paths


def parameter_count(functions: DataFrame, key: str = "ast_node_id", parameters: str = "parameters") -> DataFrame:
    """MT1: parameters of each function; functions without any have no row (JN3)."""
    return functions.select(key, F.explode(parameters)).groupBy(key).agg(F.count("*").cast("double").alias("value"))


def function_mccabe(functions: DataFrame) -> DataFrame:
    """MT2."""
    return functions.select("ast_node_id", F.col("mccabe").cast("double").alias("value"))


def first_definition(nodes: DataFrame, entity: str = "entity_hash", node: str = "id") -> DataFrame:
    """JN12: of each entity's definitions the one of smallest id."""
    w = Window.partitionBy(entity).orderBy(node)
    return nodes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def type_sum(types: DataFrame, methods: DataFrame, key: str, value: str) -> DataFrame:
    """AG9: sum of the methods' values for each type, missing ones as 0."""
    total = methods.groupBy(key).agg(F.sum(F.coalesce(value, F.lit(0))).alias("value"))
    return types.select(key).join(total, key, "left").select(key, F.coalesce("value", F.lit(0)).cast("double").alias("value"))


def type_mccabe(records: DataFrame, members: DataFrame, nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """MT3: sum over a type's explicit methods, by their first definition; no template instantiations."""
    types = records.where(~F.array_contains("tags", "TemplateInstantiation")).select(F.col("entity_hash").alias("type_hash"))
    entity = nodes.select(F.col("id").alias("member_ast_node"), F.col("entity_hash").alias("m"))
    methods = members.where("kind = 'Method'").join(entity, "member_ast_node").select("type_hash", "m").distinct()
    defined = first_definition(nodes.where("ast_type = 'Definition'")).select(F.col("entity_hash").alias("m"), F.col("id").alias("ast_node_id"))
    explicit = functions.where(~F.array_contains("tags", "Implicit")).select("ast_node_id", "mccabe")
    return type_sum(types.distinct(), methods.join(defined, "m").join(explicit, "ast_node_id"), "type_hash", "mccabe")


def ratio(numerator, denominator, empty: float):
    """AG11: numerator / denominator, `empty` where the denominator is 0."""
    return F.when(F.col(denominator) == 0, F.lit(empty)).otherwise(F.col(numerator) / F.col(denominator))


def bumpy_road(functions: DataFrame) -> DataFrame:
    """MT4."""
    return functions.select("ast_node_id", ratio("bumpiness", "statement_count", 1.0).alias("value"))


def type_sizes(types: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    """type, f, m: distinct fields and methods of each type."""
    f = fields.groupBy("type").agg(F.countDistinct("field").alias("f"))
    m = methods.groupBy("type").agg(F.countDistinct("method").alias("m"))
    return types.select("type").distinct().join(f, "type", "left").join(m, "type", "left").fillna(0, ["f", "m"])


def cohesion_values(counted: DataFrame) -> DataFrame:
    """type, loc, loc_hs of type, f, m and c, the pairs of a method and a field that it uses."""
    trivial = (F.col("f") == 0) | (F.col("m") == 0)
    loc = F.when(trivial, F.lit(0.0)).otherwise(1 - F.col("c") / (F.col("m") * F.col("f")))
    hs = F.when(trivial, F.lit(0.0)).when(F.col("m") == 1, F.lit(float("nan"))).otherwise((F.col("m") - F.try_divide("c", "f")) / F.nullif(F.col("m") - 1, F.lit(0)))
    return counted.select("type", loc.alias("loc"), hs.alias("loc_hs"))


def cohesion(types: DataFrame, fields: DataFrame, methods: DataFrame, uses: DataFrame) -> DataFrame:
    """MT5, MT6: type, loc, loc_hs.  fields: type, field; methods: type, method; uses: method, field (any repeats)."""
    used = uses.select("method", "field").distinct().join(methods.select("type", "method").distinct(), "method").join(fields.select("type", "field").distinct(), ["type", "field"])
    c = used.groupBy("type").agg(F.count("*").alias("c"))
    return cohesion_values(type_sizes(types, fields, methods).join(c, "type", "left").fillna(0, ["c"]))


def used_fields(methods: DataFrame, accesses: DataFrame) -> DataFrame:
    """JN8: (method, field) of reads and writes within a method's body, both ends inclusive."""
    from . import ranges

    both = ranges.within_inclusive(accesses, methods, "path")
    return both.select(F.col("outer.method").alias("method"), F.col("inner.field").alias("field")).distinct()


def efferent(types: DataFrame, deps: DataFrame, entity: str = "entity", dependency: str = "dependency") -> DataFrame:
    """MT7: distinct dependencies of each type, 0 if none; a type is no dependency of its own."""
    n = deps.where(F.col(entity) != F.col(dependency)).groupBy(entity).agg(F.countDistinct(dependency).alias("value"))
    return types.select(entity).distinct().join(n, entity, "left").select(entity, F.coalesce("value", F.lit(0)).alias("value"))


def afferent(types: DataFrame, deps: DataFrame, entity: str = "entity", dependency: str = "dependency") -> DataFrame:
    """MT8."""
    return efferent(types, deps.select(F.col(dependency).alias(entity), F.col(entity).alias(dependency)), entity, dependency)


def located(deps: DataFrame, nodes: DataFrame, definition: str = "Definition") -> DataFrame:
    """JN2: dependency rows with the paths of both ends' definitions; several definitions give several rows."""
    d = nodes.where(F.col("ast_type") == definition) if "ast_type" in nodes.columns else nodes
    x = deps.join(d.select(F.col("entity"), F.col("path").alias("entity_path")), "entity")
    return x.join(d.select(F.col("entity").alias("dependency"), F.col("path").alias("dependency_path")), "dependency")


def module_efferent(modules: DataFrame, rows: DataFrame, of: str = "dependency", inside: str = "entity_path", outside: str = "dependency_path", raw_prefix: bool = False) -> DataFrame:
    """MT9: for each module (dir) the distinct `of` of rows whose one end lies under it and the other doesn't.

    The ends' ancestors are exploded and joined by equality; a row is outside if no ancestor of its other end is the
    module, which the arrays tell without a join."""
    if raw_prefix:
        hit = rows.join(modules.select("dir").distinct(), expr.under(F.col(inside), F.col("dir"), True)).where(~expr.under(F.col(outside), F.col("dir"), True))
    else:
        hit = paths.members(rows, modules, inside).where(~F.array_contains(F.concat(expr.ancestors(outside), F.array(outside)), F.col("dir")))
    n = hit.groupBy("dir").agg(F.countDistinct(of).alias("value"))
    return modules.select("dir").distinct().join(n, "dir", "left").select("dir", F.coalesce("value", F.lit(0)).alias("value"))


def module_afferent(modules: DataFrame, rows: DataFrame, raw_prefix: bool = False) -> DataFrame:
    """MT10: distinct types outside that depend on types inside."""
    return module_efferent(modules, rows, "entity", "dependency_path", "entity_path", raw_prefix)


def relational_cohesion(modules: DataFrame, rows: DataFrame, records: DataFrame) -> DataFrame:
    """MT11: (R + 1) / N, R the rows (repeats counted) with both ends inside, N the records inside; 0 if N = 0."""
    inside = paths.members(rows, modules, "entity_path").where(F.array_contains(F.concat(expr.ancestors("dependency_path"), F.array("dependency_path")), F.col("dir")))
    r = inside.groupBy("dir").agg(F.count("*").alias("r"))
    n = paths.members(records, modules, "path").groupBy("dir").agg(F.count("*").alias("n"))
    x = modules.select("dir").distinct().join(r, "dir", "left").join(n, "dir", "left").fillna(0, ["r", "n"])
    return x.select("dir", F.when(F.col("n") == 0, F.lit(0.0)).otherwise((F.col("r") + 1) / F.nullif("n", F.lit(0))).alias("value"))


def module_set(files: DataFrame, configured: list[str] | None = None, inputs: list[str] | None = None) -> DataFrame:
    """MT12: configured directories, or all under the inputs."""
    if configured is not None:
        return files.where(F.col("path").isin(*configured)).select(F.col("path").alias("dir")).distinct()
    d = paths.directories(files).select(F.col("path").alias("dir"))
    return d if not inputs else d.where(in_scope("dir", inputs))


def in_scope(path: str, inputs: list[str]):
    """MT13: under one of the inputs."""
    out = F.lit(False)
    for p in inputs:
        out = out | expr.under(path, F.lit(p))
    return out


def scoped_records(records: DataFrame, inputs: list[str], ignore_lambdas: bool = True, ignore_nested: bool = False) -> DataFrame:
    """MT13 for types: records need a path column."""
    out = records.where(in_scope("path", inputs))
    if ignore_lambdas:
        out = out.where(~F.col("is_lambda"))
    return out.where("context IS NULL OR context = ''") if ignore_nested else out


def metrics_list(metrics: DataFrame, key: str = "id") -> DataFrame:
    """AG8: each node's (type, value) pairs in order of type."""
    return metrics.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("type", "value"))).alias("metrics"))


def metrics_map(metrics: DataFrame, key: str = "id") -> DataFrame:
    """AG8: as a map; of a repeated type the smallest value counts."""
    one = metrics.groupBy(key, "type").agg(F.min("value").alias("value"))
    return one.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "value")))).alias("metrics"))


def for_path(metrics: DataFrame, nodes: DataFrame, files: DataFrame, directory: str) -> DataFrame:
    """JN1, MT16: metrics of the nodes of files under a directory, with node value and path."""
    f = files.where(expr.under("path", F.lit(directory))).select(F.col("id").alias("file_id"), "path")
    n = nodes.select(F.col("id").alias("ast_node_id"), "file_id", "ast_value")
    return metrics.join(n, "ast_node_id").join(f, "file_id").select("ast_node_id", "ast_value", expr.directory_with_slash("path").alias("directory"), expr.filename("path").alias("filename"), "type", "value")


def _paged(metrics: DataFrame, key: str, files: DataFrame, size: int | None, previous) -> DataFrame:
    """Metrics joined with their files, of the next `size` keys after `previous` that are in `files`."""
    x = metrics.join(files, "file_id")
    return x if size is None else x.join(page(x, key, size, previous), key, "left_semi")


def _files_under(files: DataFrame, directory: str, raw_prefix: bool) -> DataFrame:
    return files.where(expr.under("path", F.lit(directory), raw_prefix)).select(F.col("id").alias("file_id"), "path")


def node_entries(metrics: DataFrame, nodes: DataFrame, files: DataFrame, directory: str, size: int | None = None, previous=None, raw_prefix: bool = False) -> DataFrame:
    """MT16: each node under a directory with its metrics (path, type, value) in order of type; a page of nodes if a size
    is given."""
    placed = metrics.join(nodes.select(F.col("id").alias("ast_node_id"), "file_id"), "ast_node_id")
    rows = _paged(placed, "ast_node_id", _files_under(files, directory, raw_prefix), size, previous)
    return rows.groupBy("ast_node_id").agg(F.sort_array(F.collect_list(F.struct("type", "value", "path"))).alias("m")).select("ast_node_id", F.transform("m", lambda x: F.struct(x["path"].alias("path"), x["type"].alias("type"), x["value"].alias("value"))).alias("metrics"))


def node_details(metrics: DataFrame, nodes: DataFrame, files: DataFrame, directory: str, size: int | None = None, previous=None, raw_prefix: bool = False) -> DataFrame:
    """MT16: each node under a directory with its place, kind and value, and its metrics as a map (of a repeated type the
    smallest value counts)."""
    facts = nodes.select(F.col("id").alias("ast_node_id"), "file_id", "symbol_type", "ast_type", "start_line", "end_line", "ast_value")
    rows = _paged(metrics.join(facts, "ast_node_id"), "ast_node_id", _files_under(files, directory, raw_prefix), size, previous)
    about = ["ast_node_id", "path", "symbol_type", "ast_type", "start_line", "end_line", "ast_value"]
    one = rows.groupBy(*about, "type").agg(F.min("value").alias("value"))
    out = one.groupBy(*about).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "value")))).alias("metrics"))
    return out.select("ast_node_id", expr.directory_with_slash("path").alias("path"), expr.filename("path").alias("file"), *about[2:], "metrics")


def module_entries(metrics: DataFrame, files: DataFrame, directory: str, size: int | None = None, previous=None, raw_prefix: bool = False) -> DataFrame:
    """MT16: each module (file or directory) under a directory with its metrics (path, type, value)."""
    rows = _paged(metrics, "file_id", _files_under(files, directory, raw_prefix), size, previous)
    return rows.groupBy("file_id", "path").agg(F.sort_array(F.collect_list(F.struct("type", "value"))).alias("m")).select("file_id", F.transform("m", lambda x: F.struct(F.col("path").alias("path"), x["type"].alias("type"), x["value"].alias("value"))).alias("metrics"))


def single(metrics: DataFrame, node: int, kind: int, key: str = "ast_node_id") -> float:
    """MT16: one metric; an error if there is none."""
    row = metrics.where((F.col(key) == node) & (F.col("type") == kind)).select("value").first()
    if row is None:
        raise LookupError(f"no metric of type {kind} for {node}")
    return row[0]


def page(ids: DataFrame, key: str, size: int, previous=None) -> DataFrame:
    """SO5: the next `size` distinct keys after `previous`, in order."""
    if size <= 0:
        raise ValueError("a page has at least one row")
    after = ids.select(key) if not previous else ids.select(key).where(F.col(key) > previous)
    return after.distinct().orderBy(key).limit(size)


def page_rows(rows: DataFrame, ids: DataFrame, key: str, size: int, previous=None) -> DataFrame:
    """SO6: the rows of a page's keys."""
    return rows.join(page(ids, key, size, previous), key, "left_semi").orderBy(key)


def with_summary(stats: DataFrame, group: str = "group", key: str = "key", value: str = "value") -> DataFrame:
    """AG7: the groups' rows and a group Summary with the sums by key."""
    total = stats.groupBy(key).agg(F.sum(value).alias(value)).select(F.lit("Summary").alias(group), key, value)
    return stats.select(group, key, value).unionByName(total)
