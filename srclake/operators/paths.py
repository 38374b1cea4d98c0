"""Directory trees over path columns: ancestor explosion instead of prefix joins (JN11, GR5-GR7, MT12, MT17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr


def with_ancestors(df: DataFrame, path: str, name: str = "dir") -> DataFrame:
    """A row for each of the path's directories."""
    return df.withColumn(name, F.explode(expr.ancestors(path)))


def members(files: DataFrame, dirs: DataFrame, path: str = "path", directory: str = "dir", raw_prefix: bool = False) -> DataFrame:
    """JN11: (directory, file row) for files under each directory.

    An equi-join on exploded ancestors; raw_prefix keeps the string-prefix semantics, with an equality on the characters
    that the shortest directory has (without any, a nested loop)."""
    if not raw_prefix:
        each = files.withColumn("_dir", F.explode(F.concat(expr.ancestors(path), F.array(path))))
        return each.join(dirs.select(F.col(directory).alias("_dir")).distinct(), "_dir").withColumnRenamed("_dir", directory)
    # equality on the first characters, as many as the shortest directory has up to its first wildcard
    d = dirs.select(F.col(directory).alias("_dir")).distinct().withColumn("_fixed", F.length(F.regexp_extract("_dir", "^[^%_\\\\]*", 0)))
    n = d.agg(F.min("_fixed")).first()[0]
    if not n:
        return files.join(d, expr.under(F.col(path), F.col("_dir"), raw_prefix=True)).drop("_fixed").withColumnRenamed("_dir", directory)
    x = files.withColumn("_head", F.substring(path, 1, n)).join(d.withColumn("_head", F.substring("_dir", 1, n)), "_head")
    return x.where(expr.under(F.col(path), F.col("_dir"), raw_prefix=True)).drop("_head", "_fixed").withColumnRenamed("_dir", directory)


def directories(files: DataFrame, path: str = "path") -> DataFrame:
    """All directories of the files (SRC2's parent chain): path, parent."""
    return with_ancestors(files.select(path), path).select("dir").distinct().select(F.col("dir").alias("path"), expr.parent("dir").alias("parent"))


def children(nodes: DataFrame, parent: str, path: str = "path") -> DataFrame:
    """GR7, GR12: entries right below a directory; directories first, then by name (SO3)."""
    return listing(nodes.where(expr.parent(path) == parent), path)


def listing(nodes: DataFrame, path: str = "path") -> DataFrame:
    """SO3."""
    return nodes.orderBy(F.desc("is_dir"), expr.filename(path))


def subtree(nodes: DataFrame, root: str, path: str = "path") -> DataFrame:
    """GR5: everything below and the root itself, in pre-order."""
    return nodes.where(expr.under(path, F.lit(root))).orderBy(F.split(path, "/"))


def path_to_root(nodes: DataFrame, file_path: str, path: str = "path") -> DataFrame:
    """GR6: the file and its directories, root last."""
    wanted = F.array(*(F.lit("/".join(file_path.split("/")[:i])) for i in range(2, len(file_path.split("/")) + 1)))
    return nodes.where(F.array_contains(wanted, F.col(path))).orderBy(F.desc(F.length(path)))


def open_tree(nodes: DataFrame, file_path: str, path: str = "path") -> DataFrame:
    """GR6: the entries of every directory on the way to the file."""
    dirs = ["/".join(file_path.split("/")[:i]) for i in range(1, len(file_path.split("/")))]
    return nodes.where(expr.parent(path).isin(*dirs)).orderBy(F.split(path, "/"))


def rollup(values: DataFrame, path: str, value: str) -> DataFrame:
    """MT17: sum per directory."""
    return with_ancestors(values, path).groupBy("dir").agg(F.sum(value).alias(value), F.count("*").alias("files"))


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """JN15: each path's longest directory among roots; paths of none go."""
    each = paths.withColumn("_dir", F.explode(F.concat(expr.ancestors(path), F.array(path))))
    hit = each.join(roots.select(F.col(root).alias("_dir")).distinct(), "_dir")
    return hit.groupBy(path).agg(F.max_by("_dir", F.length("_dir")).alias(root))
