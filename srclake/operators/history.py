"""Version history (HS*, SO9)."""

from __future__ import annotations

import bisect
import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from . import graph


def ancestors_of(commits: DataFrame, oid: str) -> DataFrame:
    """The commit and all its ancestors."""
    edges = commits.select("oid", F.explode("parents").alias("parent"))
    start = commits.sparkSession.createDataFrame([(oid,)], "start string")
    reached = graph.bfs(edges, start, None, "oid", "parent").select(F.col("node").alias("oid")).unionByName(start.select(F.col("start").alias("oid"))).distinct()
    return commits.join(reached, "oid", "left_semi")


def matching(commits: DataFrame, text: str) -> DataFrame:
    """HS1's filter: message, author or committer holds the text, whatever its case."""
    cond = F.lit(False)
    for c in ("message", "author", "committer"):
        if c in commits.columns:
            cond = cond | expr.contains_ignore_case(F.col(c).cast("string"), F.lit(text))
    return commits.where(cond)


def log(commits: DataFrame, count: int, offset: int = 0, text: str | None = None, compat: bool = False) -> DataFrame:
    """HS1, SO9: newest first, `count` commits after `offset` (count -1: all).  compat: the offset skips one fewer and
    count -1 returns nothing (Q3)."""
    c = commits if text is None else matching(commits, text)
    c = c.orderBy(F.desc("time"), "oid")
    if compat:
        return c.offset(max(offset - 1, 0)).limit(max(count, 0))
    return c.offset(offset) if count < 0 else c.offset(offset).limit(count)


def has_remaining(commits: DataFrame, count: int, offset: int, text: str | None = None) -> bool:
    c = commits if text is None else matching(commits, text)
    return count >= 0 and not c.orderBy(F.desc("time"), "oid").offset(offset + count).isEmpty()


def commit(commits: DataFrame, oid: str) -> DataFrame:
    """HS2."""
    return commits.where(F.col("oid") == oid)


def parents(commits: DataFrame, oid: str) -> DataFrame:
    """HS2: the parents, in order."""
    p = commit(commits, oid).select(F.posexplode("parents").alias("n", "parent"))
    return p.join(commits, F.col("oid") == F.col("parent")).orderBy("n").drop("n", "parent")


def reference_names(refs: DataFrame) -> DataFrame:
    """HS3: refs (kind, name, is_head) with full names: all remotes and tags, of local branches only the head."""
    lead = F.when(F.col("kind") == "remote", "refs/remotes/").when(F.col("kind") == "tag", "refs/tags/").otherwise("refs/heads/")
    return refs.where("kind <> 'local' OR is_head").select("kind", F.concat(lead, F.col("name").cast("string")).alias("ref"))


def reference_top(refs: DataFrame, objects: DataFrame, ref: str) -> DataFrame:
    """HS4: id and type of what a reference points to."""
    return refs.where(F.col("name") == ref).join(objects, "oid").select("oid", "type")


def diff(old: str, new: str, context: int = 3, names: tuple[str, str] = ("a", "b")) -> str:
    """HS5: unified diff of two texts."""
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), *names, n=context))


def diff_table(old: DataFrame, new: DataFrame, context: int = 3, pathspec: str | None = None, compact: bool = False) -> DataFrame:
    """HS5 for whole trees (path, content): path, status, and the diff unless compact."""
    o = old.select("path", F.col("content").alias("o"))
    n = new.select("path", F.col("content").alias("n"))
    x = o.join(n, "path", "full").where(~F.col("o").eqNullSafe(F.col("n")))
    if pathspec:
        x = x.where(F.col("path").like(pathspec.replace("*", "%")))
    status = F.when(F.col("o").isNull(), "A").when(F.col("n").isNull(), "D").otherwise("M")
    if compact:
        return x.select("path", status.alias("status"))

    @F.pandas_udf("string")
    def run(a, b):
        import pandas as pd

        return pd.Series([diff(p or "", q or "", context) for p, q in zip(a, b, strict=True)])

    return x.select("path", status.alias("status"), run("o", "n").alias("diff"))


def blame_hunks(lines: DataFrame, path: str = "path", line: str = "line", oid: str = "commit_oid") -> DataFrame:
    """HS6: runs of neighbouring lines of one commit: path, commit, first line, number of lines."""
    w = Window.partitionBy(path).orderBy(line)
    new = lines.withColumn("_new", (~F.col(oid).eqNullSafe(F.lag(oid).over(w))).cast("int"))
    runs = new.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(path, "_g", oid).agg(F.min(line).alias("first_line"), F.count("*").alias("n_lines")).drop("_g")


#: The commit of lines that aren't committed.
UNCOMMITTED = "0" * 40


def common_lines(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places (from 0): a longest rising run through the places at which each
    old line stands among the new ones."""
    places: dict[str, list[int]] = {}
    for j, x in enumerate(new):
        places.setdefault(x, []).append(j)
    ends: list[int] = []  # the least last place of a run of each length, and that run
    runs: list[tuple] = []
    for i, x in enumerate(old):
        for j in reversed(places.get(x, ())):
            k = bisect.bisect_left(ends, j)
            run = (i, j, runs[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                runs.append(run)
            elif j < ends[k]:
                ends[k], runs[k] = j, run
    out, run = [], runs[-1] if runs else None
    while run:
        out.append(run[:2])
        run = run[2]
    return out[::-1]


def overlaid(blame: DataFrame, committed: DataFrame, working: DataFrame) -> DataFrame:
    """HS6: blame (path, line, commit_oid) of committed texts carried over to the working texts (path, content): lines of
    a longest common subsequence keep their commit, the others are UNCOMMITTED.  path, line, commit_oid, orig_line.

    Files with a working text only are all uncommitted; a null text is one without lines; paths must not repeat."""
    texts = working.select("path", F.col("content").alias("new")).join(committed.select("path", F.col("content").alias("old")), "path", "left").where("path IS NOT NULL")

    def run(batches):
        for pdf in batches:
            for path, new, old in zip(pdf["path"], pdf["new"], pdf["old"], strict=True):
                lines = lambda t: t.split("\n") if isinstance(t, str) else []
                fresh, known = lines(new), lines(old)
                head = 0
                while head < min(len(fresh), len(known)) and fresh[head] == known[head]:
                    head += 1
                tail = 0
                while tail < min(len(fresh), len(known)) - head and fresh[-1 - tail] == known[-1 - tail]:
                    tail += 1
                of = {j: j for j in range(head)} | {len(fresh) - 1 - k: len(known) - 1 - k for k in range(tail)}
                of |= {head + j: head + i for i, j in common_lines(known[head : len(known) - tail], fresh[head : len(fresh) - tail])}
                if fresh:
                    yield pd.DataFrame({"path": path, "line": range(1, len(fresh) + 1), "orig_line": pd.array([of[j] + 1 if j in of else None for j in range(len(fresh))], "Int32")})

    rows = texts.mapInPandas(run, "path string, line int, orig_line int")
    b = blame.select("path", F.col("line").alias("orig_line"), "commit_oid")
    return rows.join(b, ["path", "orig_line"], "left").select("path", "line", F.coalesce("commit_oid", F.lit(UNCOMMITTED)).alias("commit_oid"), "orig_line")


def repository_of(paths: DataFrame, repositories: DataFrame) -> DataFrame:
    """HS7, JN15."""
    from . import paths as p

    return p.longest_prefix(paths, repositories)


def blob_id(trees: DataFrame, oid: str, path: str) -> DataFrame:
    """HS7: id of the blob at a path of a commit's tree.  trees: commit_oid, path, blob_oid."""
    return trees.where((F.col("commit_oid") == oid) & (F.col("path") == path)).select("blob_oid")


def blob_content(blobs: DataFrame, blob_oid: str) -> DataFrame:
    """HS7.  blobs: oid, content."""
    return blobs.where(F.col("oid") == blob_oid).select("content")


def repository_list(repositories: DataFrame) -> DataFrame:
    """HS7: id, path, head of all repositories, by path; `available` if they have a head."""
    return repositories.select("id", "path", "head", F.col("head").isNotNull().alias("available")).orderBy("path")
