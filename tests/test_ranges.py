"""Containment joins against brute force, and that they don't pair whole files."""

import random

from pyspark.sql import functions as F

from srclake.operators import ranges

POSITION = "start_line int, start_col int, end_line int, end_col int"


def _random(n: int, longest: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.randrange(600)
        b = a + int(longest ** r.random()) - 1
        c = r.randrange(9)
        out.append((i, i % 2, a, c, b, c + 1 + r.randrange(9)))
    return out


def test_ranges_of_all_lengths(spark):
    inner, outer = _random(300, 20, 1), _random(300, 600, 2)
    i, o = (spark.createDataFrame(x, f"id int, file_id long, {POSITION}") for x in (inner, outer))
    for found, ends in ((ranges.within(i, o), lambda x, y: x < y), (ranges.within_inclusive(i, o, "file_id"), lambda x, y: x <= y)):
        got = sorted(tuple(r) for r in found.select(F.col("inner.id"), F.col("outer.id")).collect())
        want = sorted((x[0], y[0]) for x in inner for y in outer if x[1] == y[1] and x[2:4] >= y[2:4] and ends(x[4:6], y[4:6]))
        assert got == want and len(want) > 300


def test_files_pairs_dont_meet(spark):
    """3,000 functions of ten lines and 30,000 uses in one file: what meets is a few times what is found."""
    o = spark.range(3000).select(F.col("id"), F.lit(1).alias("file_id"), (F.col("id") * 10 + 1).cast("int").alias("start_line"), F.lit(1).alias("start_col"), (F.col("id") * 10 + 10).cast("int").alias("end_line"), F.lit(99).alias("end_col"))
    i = spark.range(30000).select(F.col("id"), F.lit(1).alias("file_id"), (F.col("id") + 1).cast("int").alias("start_line"), F.lit(1).alias("start_col"), (F.col("id") + 1).cast("int").alias("end_line"), F.lit(2).alias("end_col"))
    assert ranges.within(i, o).count() == 30000
    assert ranges._join(i, o, "file_id", F.lit(True), None).count() <= 4 * 30000
