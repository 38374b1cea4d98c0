"""Containment and stabbing joins of source ranges (JN6-JN10).

Every join has an equality on the file and on a bucket of lines.  Outer ranges have levels: at level k buckets of 2^k
lines, the fewest that a range spans two of at most, so it takes one or two rows, however long it is.  An inner range
takes the bucket of its start at each level that occurs, and a pair meets in one bucket only.  What meets in vain is
within a few lengths of the outer range, so the work grows with the rows and the pairs found, not with a file's pairs.
`bucket_lines` sets buckets of one size instead: an outer range takes a row for each that it spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITION = ("start_line", "start_col", "end_line", "end_col")


def _start(side: str) -> Column:
    return F.struct(F.col(f"{side}_start_line"), F.col(f"{side}_start_col"))


def _end(side: str) -> Column:
    return F.struct(F.col(f"{side}_end_line"), F.col(f"{side}_end_col"))


def _bucket(line: str, level: str) -> Column:
    """The bucket of 2^level lines."""
    return F.call_function("shiftright", F.col(line).cast("long"), F.col(level))


def _join(inner: DataFrame, outer: DataFrame, file: str, residual: Column, bucket_lines: int | None) -> DataFrame:
    # flat columns, structs of the pairs found only
    i = inner.select(F.col(file).alias("_f"), *(F.col(c).alias(f"inner_{c}") for c in inner.columns))
    o = outer.where("end_line IS NOT NULL").select(F.col(file).alias("_f"), *(F.col(c).alias(f"outer_{c}") for c in outer.columns))
    if bucket_lines:
        keys = ["_f", "_b"]
        i = i.withColumn("_b", F.floor(F.col("inner_start_line") / bucket_lines))
        o = o.withColumn("_b", F.explode(F.sequence(F.floor(F.col("outer_start_line") / bucket_lines), F.floor(F.col("outer_end_line") / bucket_lines))))
    else:
        keys = ["_f", "_l", "_b"]
        o = o.withColumn("_l", F.ceil(F.log2(F.greatest(F.col("outer_end_line") - F.col("outer_start_line"), F.lit(0)) + F.lit(1))).cast("int"))
        levels = F.broadcast(o.agg(F.collect_set("_l").alias("_ls")))  # one row, of 32 numbers at most
        o = o.withColumn("_b", F.explode(F.array_distinct(F.array(_bucket("outer_start_line", "_l"), _bucket("outer_end_line", "_l")))))
        i = i.crossJoin(levels).withColumn("_l", F.explode("_ls")).withColumn("_b", _bucket("inner_start_line", "_l")).drop("_ls")
    pair = [F.struct(*(F.col(f"{side}_{c}").alias(c) for c in df.columns)).alias(side) for side, df in (("inner", inner), ("outer", outer))]
    return i.join(o, keys).where(residual).select(*pair)


def within(inner: DataFrame, outer: DataFrame, file: str = "file_id", bucket_lines: int | None = None) -> DataFrame:
    """JN6: inner.start >= outer.start and inner.end < outer.end; rows of structs inner and outer."""
    return _join(inner, outer, file, (_start("inner") >= _start("outer")) & (_end("inner") < _end("outer")), bucket_lines)


def enclosing(usages: DataFrame, scopes: DataFrame, file: str = "file_id", bucket_lines: int | None = None) -> DataFrame:
    """JN7: scopes around usages: scope.start <= usage.start and scope.end > usage.end."""
    return within(usages, scopes, file, bucket_lines)


def within_inclusive(inner: DataFrame, outer: DataFrame, file: str = "path", bucket_lines: int | None = None) -> DataFrame:
    """JN8: both ends inclusive."""
    return _join(inner, outer, file, (_start("inner") >= _start("outer")) & (_end("inner") <= _end("outer")), bucket_lines)


def innermost(points: DataFrame, nodes: DataFrame, file: str = "file_id", macro: str | None = None, bucket_lines: int = 500) -> DataFrame:
    """JN9: for each point (line, col) the innermost visible node with start <= point < end.

    Macro nodes come first; then the latest start, the earliest end and the smallest id (Q9).  points need point_id."""
    bucket = lambda c: F.floor(F.col(c) / bucket_lines)
    n = nodes.where("visible AND end_line >= start_line").withColumn("_b", F.explode(F.sequence(bucket("start_line"), bucket("end_line"))))
    p = points.select(F.col(file).alias("_f"), "point_id", F.struct("line", "col").alias("_p"), bucket("line").alias("_b"))
    x = p.join(n.withColumnRenamed(file, "_f"), ["_f", "_b"]).drop("_b").where((F.struct("start_line", "start_col") <= F.col("_p")) & (F.struct("end_line", "end_col") > F.col("_p")))
    first = [F.desc(F.col(macro))] if macro else []
    w = Window.partitionBy("point_id").orderBy(*first, F.desc("start_line"), F.desc("start_col"), "end_line", "end_col", "id")
    return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p").withColumnRenamed("_f", file)


def shortest_at(points: DataFrame, names: DataFrame, file: str = "file_id") -> DataFrame:
    """JN10: for each point the name on its line whose columns cover it (both inclusive) and whose value is shortest."""
    p = points.select(F.col(file).alias("_f"), "point_id", F.col("line").alias("_l"), F.col("col").alias("_c"))
    x = p.join(names, (names[file] == F.col("_f")) & (F.col("line_start") == F.col("_l"))).where("column_start <= _c AND _c <= column_end")
    w = Window.partitionBy("point_id").orderBy(F.length("value"), "id")
    return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_f", "_l", "_c")
