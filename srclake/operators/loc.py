"""Lines of code (MT14, MT15)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr

#: Comment marks by file type (fixed values): single-line mark, block start, block end.
COMMENTS = {
    "CPP": ("//", "/*", "*/"), "Java": ("//", "/*", "*/"), "Erlang": ("#", "", ""), "Bash": ("#", "", ""), "Perl": ("#", "", ""),
    "Python": ("#", '"""', '"""'), "Sql": ("--", "/*", "*/"), "Ruby": ("#", "=begin", "\n=end"),
}
ORIGINAL, NONBLANK, CODE = 1, 2, 3


def without_comments(text: str, single: str, start: str, end: str) -> str:
    """Q7: single-line marks go first, to the end of their line, wherever they stand; then blocks.

    A block's end is looked for after its start mark, and the cut reaches the start mark's length beyond it.  A block
    without an end is cut to the end of the text, but one within the first characters loses only what the wrapped length
    says.  After a cut the search goes on where a mark could have been joined."""
    if single:
        text = "\n".join(line.split(single, 1)[0] for line in text.split("\n"))
    size, at = len(start), 0
    while start and (a := text.find(start, at)) >= 0:
        b = text.find(end, a + size)
        cut = b - a + size if b >= 0 else ((1 << 64) - 1 - a + size) % (1 << 64)
        text = text[:a] + (text[a + cut :] if cut else "")
        at = max(0, a - size + 1)
    return text


def code_text(text, kind):
    """The text without blank lines and then without comments, by file type; a pandas UDF."""

    @F.pandas_udf("string")
    def run(t: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else without_comments(x, *COMMENTS.get(y, ("", "", ""))) for x, y in zip(t, k, strict=True)])

    return run(expr.without_blank_lines(text), kind)


def lines_of_code(files: DataFrame, done: DataFrame | None = None, file: str = "id", content: str = "content", kind: str = "type", python: bool = True) -> DataFrame:
    """MT14: file, type, metric (original, non-blank, code lines); zeros have no row; files in `done` are skipped (JN5).

    python=False leaves comments in, for text without comment marks, and stays within built-in functions."""
    f = files if done is None else files.join(done.select(file), file, "left_anti")
    squeezed = expr.without_blank_lines(content)
    # only texts with comment marks go through Python
    marked = F.lit(False)
    for name, (single, start, _) in COMMENTS.items():
        has = [F.contains(F.col(content), F.lit(m)) for m in (single, start) if m]
        marked = marked | ((F.col(kind) == name) & (has[0] | has[-1]))
    marked = F.coalesce(marked, F.lit(False))
    code = F.when(marked, code_text(F.when(marked, F.col(content)), F.col(kind))).otherwise(squeezed) if python else squeezed
    n = F.array(*(F.struct(F.lit(t).alias("type"), F.coalesce(expr.line_count(c), F.lit(0)).alias("metric")) for t, c in ((ORIGINAL, F.col(content)), (NONBLANK, squeezed), (CODE, code))))
    return f.select(file, F.explode(n).alias("m")).select(file, "m.type", "m.metric").where("metric > 0")


def loc_entries(metrics: DataFrame, files: DataFrame, directory: str, types: list[str], metric_type: int) -> DataFrame:
    """MT15: path, parent, is_dir, metric of a directory's files of some types and of the directories that lead to them,
    whose metric is the sum of their files'."""
    chosen = files.where(F.col("type").isin(*types) & expr.under("path", F.lit(directory))).select("id", "path")
    rows = metrics.where(F.col("type") == metric_type).join(chosen, "id").select("path", F.col("metric").cast("long").alias("metric"))
    dirs = rows.select(F.explode(expr.ancestors("path")).alias("path"), "metric").where("path <> ''").groupBy("path").agg(F.sum("metric").alias("metric"))
    both = rows.withColumn("is_dir", F.lit(False)).unionByName(dirs.withColumn("is_dir", F.lit(True)))
    return both.select("path", expr.parent("path").alias("parent"), "is_dir", "metric")


def loc_tree(metrics: DataFrame, files: DataFrame, directory: str, types: list[str], metric_type: int, limit: int = 100_000) -> str:
    """MT15, SNK5: nested JSON of a directory's metrics; '' without types.  The result is one document for one reader, so
    a directory of more than `limit` files is an error; loc_entries has no bound."""
    if not types:
        return ""
    rows = loc_entries(metrics, files, directory, types, metric_type).where("NOT is_dir").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} files")
    tree: dict = {}
    for r in rows:
        at = tree
        *dirs, name = r["path"].split("/")
        for d in dirs:
            at = at.setdefault(d, {})
        at[name] = r["metric"]
    return json.dumps(tree, sort_keys=True)
