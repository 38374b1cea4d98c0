"""Incremental maintenance of fact tables (IN*, SRC14, SRC19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def changes(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "hash", added: bool = False) -> DataFrame:
    """IN1: key, status: MODIFIED or DELETED (ADDED only if asked for)."""
    o, n = old.select(key, F.col(digest).alias("_o")), new.select(key, F.col(digest).alias("_n"))
    s = F.when(F.col("_n").isNull(), "DELETED").when(F.col("_o").isNull(), "ADDED" if added else F.lit(None)).when(F.col("_o") != F.col("_n"), "MODIFIED")
    return o.join(n, key, "full" if added else "left").select(key, s.alias("status")).where("status IS NOT NULL")


def changed_actions(stored: DataFrame, current: DataFrame, command: str = "command") -> DataFrame:
    """IN2, ST4: stored commands that are no longer there."""
    return stored.join(current.select(command).distinct(), command, "left_anti")


def dependents(includes: DataFrame, modified: DataFrame) -> DataFrame:
    """IN2: modified files and all that include them."""
    return graph.impact(includes, modified)


def needs_full_rebuild(changed: int, total: int, percent: int = 10) -> bool:
    """IN3."""
    return changed * 100 > total * percent


def cleaned(facts: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """IN4, IN5: facts without those of the given files."""
    return facts.join(files.select(key).distinct(), key, "left_anti")


def cleanup_order(files: DataFrame, includes: DataFrame) -> DataFrame:
    """IN4: levels in which files' facts may go, includers before what they include."""
    return graph.topological_levels(files, includes, "file_id", "includer", "included")


def orphan_contents(contents: DataFrame, files: DataFrame, digest: str = "hash", used: str = "content_hash") -> DataFrame:
    """IN6: contents that no file refers to any more."""
    return contents.join(files.select(F.col(used).alias(digest)).distinct(), digest, "left_anti")


def merged(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """SRC14: new rows replace old ones of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates([key]))


def with_field_values(index: DataFrame, values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """SRC19: index rows with some fields set from values where given; rows not in the index are added."""
    v = values.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    x = index.join(v, key, "full")
    return x.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in index.columns))


#: IN7: a run's phases; a plug-in's `parse` comes before the index if it doesn't need it, after it if it does.
PHASES = ["mark", "cleanup", "parse", "index", "parse indexed"]


def incremental_run(facts: dict[str, DataFrame], files: DataFrame, old: DataFrame, new: DataFrame, includes: DataFrame, parse, percent: int = 10) -> tuple[dict[str, DataFrame], dict]:
    """IN3, IN5, IN7: marks changed files and their includers, drops the facts of all of them and adds what `parse` makes
    of those that are still there; beyond `percent` of changed files everything is parsed anew.

    facts: tables with file_id; files: file_id, path of all known and new files; old, new: path, hash; includes: includer,
    included (file ids); parse: DataFrame of file_id, path -> dict of tables.  Facts and report (changed, total, full)."""
    changed = changes(old, new, added=True)
    ids = changed.join(files, "path").select("file_id", "status")
    n, total = changed.where("status <> 'ADDED'").count(), old.count()
    full = needs_full_rebuild(n, total, percent)
    marked = files.select("file_id") if full else dependents(includes, ids.select("file_id"))
    present = files.join(new.select("path"), "path", "left_semi").join(marked.distinct(), "file_id", "left_semi")
    parsed = parse(present.select("file_id", "path"))
    out = {}
    for name, table in facts.items():
        kept = table.limit(0) if full else cleaned(table, marked)
        out[name] = kept.unionByName(parsed[name]) if name in parsed else kept
    return out, {"changed": n, "total": total, "full": full}
