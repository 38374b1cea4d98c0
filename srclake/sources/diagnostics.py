"""Compilers' messages stitched from the lines of build logs (SRC11).

A message begins with `path:line:col: kind: text`; the lines that follow, up to the next one, are its source excerpt.
`In file included from` lines belong to the message that follows them.  A note belongs to the last error or warning
before it.  What is nearest is found in two steps, within blocks of lines and then over the blocks, so a very long log is
many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MESSAGE = r"^(?:([^\s:][^:\n]*):(\d+):(?:(\d+):)?|[\w./+-]+:)\s+(fatal error|error|warning|note|remark):\s+(.*)$"
LEADING = r"^(?:In file included|\s+) from ([^:\n]+):(\d+)(?::\d+)?[:,]"
KINDS = {"note": "Note", "remark": "Note", "warning": "Warning", "error": "Error", "fatal error": "FatalError"}
#: Lines of a log that are ordered in one task.
BLOCK = 10_000


def nearest(rows: DataFrame, values: dict[str, tuple[Column, bool]], block: int = BLOCK) -> DataFrame:
    """rows (log, n, ...) with, by name, the value that is not null of the nearest row up to each (or, if True, from it
    on) in its log.

    One shuffle deals the blocks for all values; what a block hands on to the next ones is joined only where there is any."""
    rows = rows.where("n IS NOT NULL").withColumn("_b", F.floor(F.col("n") / block)).withColumns({f"_{name}": v for name, (v, _) in values.items()})
    at = {name: F.when(F.col(f"_{name}").isNotNull(), F.col("n")) for name in values}
    ends = [(F.min_by if on else F.max_by)(f"_{name}", at[name]).alias(f"_{name}") for name, (_, on) in values.items()]
    blocks = rows.repartition("log", "_b").groupBy("log", "_b").agg(*ends)
    over = {on: Window.partitionBy("log").orderBy(F.desc("_b") if on else "_b").rowsBetween(Window.unboundedPreceding, -1) for on in (False, True)}  # a row for each block
    carried = blocks.select(F.col("log").alias("_log"), F.col("_b").alias("_at"), *(F.last(f"_{name}", ignorenulls=True).over(over[on]).alias(f"_c_{name}") for name, (_, on) in values.items()))
    carried = carried.where(" OR ".join(f"_c_{name} IS NOT NULL" for name in values))
    within = {on: Window.partitionBy("log", "_b").orderBy(F.desc("n") if on else "n").rowsBetween(Window.unboundedPreceding, 0) for on in (False, True)}
    out = rows.repartition("log", "_b").withColumns({f"_{name}": F.last(f"_{name}", ignorenulls=True).over(within[on]) for name, (_, on) in values.items()})
    out = out.join(carried, F.col("log").eqNullSafe(F.col("_log")) & (F.col("_b") == F.col("_at")), "left")
    out = out.withColumns({name: F.coalesce(f"_{name}", f"_c_{name}") for name in values})
    return out.drop("_b", "_log", "_at", *(f"{p}{name}" for p in ("_", "_c_") for name in values))


def messages(lines: DataFrame, log: str = "log", n: str = "n", text: str = "text", block: int = BLOCK) -> DataFrame:
    """log, n (line of the message in the log), type, message, path, line, col, excerpt, included_from (paths, the
    includer of the file last), parent (n of the error or warning that a note belongs to)."""
    rows = lines.select(F.col(log).alias("log"), F.col(n).cast("long").alias("n"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    part = lambda i: F.regexp_extract("text", MESSAGE, i)
    kind = part(4)
    rows = rows.withColumn("kind", F.when(kind != "", kind)).withColumn("leads", F.col("kind").isNull() & F.col("text").rlike(LEADING))
    head = F.col("kind").isNotNull()
    rows = nearest(
        rows,
        {
            "mark": (F.when(head | F.col("leads"), F.struct("n", head.alias("begun"))), False),
            "cause": (F.when(F.col("kind").isin("error", "warning", "fatal error"), F.col("n")), False),
            "of": (F.when(head, F.col("n")), True),  # leading lines belong to the next message: the first one after them
        },
        block,
    )
    owner = F.when(head, F.col("n")).when(F.col("leads"), F.col("of")).when(F.col("mark.begun"), F.col("mark.n"))
    line = F.struct("n", "text")
    listed = rows.withColumn("owner", owner).where("owner IS NOT NULL").groupBy("log", "owner").agg(
        F.collect_list(F.when(head, F.struct("text", "kind", "cause"))).alias("heads"), F.collect_list(F.when(~head & ~F.col("leads"), line)).alias("rest"), F.collect_list(F.when(F.col("leads"), line)).alias("led")
    )
    texts = lambda c, f: F.transform(F.sort_array(c), lambda x: f(x["text"]))
    out = listed.select("log", F.col("owner").alias("n"), F.explode("heads").alias("h"), "rest", "led").select("log", "n", "h.*", "rest", "led")
    number = lambda i: F.when(part(i) != "", part(i).cast("int"))
    names = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return out.select(
        "log", "n", names[F.col("kind")].alias("type"), part(5).alias("message"), F.when(part(1) != "", part(1)).alias("path"), number(2).alias("line"), number(3).alias("col"),
        F.when(F.size("rest") > 0, F.array_join(texts("rest", lambda t: t), "\n")).alias("excerpt"), texts("led", lambda t: F.regexp_extract(t, LEADING, 1)).alias("included_from"),
        F.when(F.col("kind").isin("note", "remark"), F.col("cause")).alias("parent"),
    )


def build_log(found: DataFrame, files: DataFrame) -> DataFrame:
    """build_log rows (type, message, file_id, start_line, start_col, end_line, end_col); files: file_id, path."""
    at = found.join(files.select(F.col("path"), "file_id"), "path", "left")
    return at.select("type", "message", "file_id", F.col("line").alias("start_line"), F.col("col").alias("start_col"), F.col("line").alias("end_line"), F.col("col").alias("end_col"))
