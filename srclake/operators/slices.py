"""Work slices of nearly equal cost (MT18).

Tasks are dealt from the dearest class of cost to the cheapest, back and forth over the slices.  A task's place comes
from a histogram (class of cost, block of keys), so no task of Spark's sees all tasks, and costs of two slices differ by
little more than the dearest task.  A task far above a slice's share has to be cut before: `cohesion` cuts a type's
methods by fields into tiles.

Slices go to partitions by their number, not by a hash of it, so that no two share a partition while another is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics

#: Tasks that are numbered together.
BLOCK = 100_000
#: Tiles that a slice holds of a type that is cut.
TILES = 8


def cost_class(cost: str) -> Column:
    """Four classes for each doubling of a whole cost; null and less than 1 are 0."""
    bits = f"length(bin(greatest(coalesce({cost}, 0), 0)))"
    return F.expr(f"CASE WHEN coalesce({cost}, 0) < 1 THEN 0 WHEN {bits} < 3 THEN 4 * {bits} ELSE 4 * {bits} + (shiftright({cost}, {bits} - 3) & 3) END").cast("int")


def deal(tasks: DataFrame, key: list[str], cost: str, slices: int, block: int = BLOCK) -> DataFrame:
    """Adds class and slice (from 0).  Keys should be unique: equal rows are dealt in any order."""
    if slices < 1:
        raise ValueError("there is at least one slice")
    blocks = 1 + tasks.count() // block
    t = tasks.withColumns({"class": cost_class(cost), "_block": F.pmod(F.xxhash64(*key), F.lit(blocks))})
    histogram = t.groupBy("class", "_block").agg(F.count("*").alias("n"))
    by_class = histogram.groupBy("class").agg(F.sum("n").alias("n"))  # some 250 rows
    dearer = by_class.select("class", (F.sum("n").over(Window.orderBy(F.desc("class"))) - F.col("n")).alias("_dearer"))
    before = histogram.select("class", "_block", (F.sum("n").over(Window.partitionBy("class").orderBy("_block")) - F.col("n")).alias("_before"))
    first = before.join(F.broadcast(dearer), "class").select("class", "_block", (F.col("_dearer") + F.col("_before")).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("class", "_block").orderBy(F.desc(cost), *key)) - 1
    at = t.withColumn("_nth", nth).join(first, ["class", "_block"]).withColumn("_at", F.col("_first") + F.col("_nth"))
    turn, place = F.floor(F.col("_at") / slices), F.col("_at") % slices
    return at.withColumn("slice", F.when(turn % 2 == 0, place).otherwise(slices - 1 - place).cast("int")).drop("_block", "_nth", "_first", "_at")


def spread(rows: DataFrame, slices: int, column: str = "slice") -> DataFrame:
    """A partition for each slice."""
    return rows.repartitionById(slices, column)


def grids(types: DataFrame, slices: int, tiles: int = TILES) -> DataFrame:
    """type, f, m -> a, b: methods are cut into a parts and fields into b, so that no tile costs (methods times fields)
    much more than a slice's share divided by `tiles`."""
    area = F.col("m") * F.col("f")
    total = types.agg(F.sum(area)).first()[0] or 0
    share = max(1, -(-total // (slices * tiles)))
    a = F.greatest(F.lit(1), F.least("m", F.ceil(area / share)))
    return types.withColumn("a", a.cast("long")).withColumn("b", F.greatest(F.lit(1), F.least("f", F.ceil(area / share / F.col("a")))).cast("long"))


def tiles_of(cut: DataFrame, slices: int) -> DataFrame:
    """type, i, j, cost, class, slice of each tile."""
    steps = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    tiles = cut.select("type", "a", "b", "m", "f", steps("a").alias("i")).select("*", steps("b").alias("j"))
    return deal(tiles.select("type", "i", "j", F.ceil(F.col("m") / F.col("a") * (F.col("f") / F.col("b"))).cast("long").alias("cost")), ["type", "i", "j"], "cost", slices)


def cohesion_pairs(types: DataFrame, fields: DataFrame, methods: DataFrame, uses: DataFrame, slices: int) -> tuple[DataFrame, DataFrame]:
    """(type, f, m) and the pairs (slice, type, i, method, field) of methods with fields of their type that they use, in a
    partition for each slice."""
    sized = metrics.type_sizes(types, fields, methods)
    cut = grids(sized, slices)
    tiles = tiles_of(cut, slices).select("type", "i", "j", "slice")
    # types in more than one tile: some `slices` times TILES, as each has a tile's share of the whole cost
    hot = F.broadcast(cut.where("a > 1 OR b > 1").select("type", "a", "b"))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.coalesce(F.col(n), F.lit(1)))
    used = uses.select("method", "field").distinct().join(methods.select("type", "method").distinct(), "method")
    used = used.join(hot, "type", "left").select("type", "method", "field", part("method", "a").alias("i"), part("field", "b").alias("j"))
    own = fields.select("type", "field").distinct().join(hot, "type", "left")
    own = own.select("type", "field", part("field", "b").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("a", F.lit(1)) - 1)).alias("i"))
    here = lambda rows: spread(rows.join(tiles, ["type", "i", "j"]), slices)
    return sized, here(used).join(here(own).select("slice", "type", "i", "field"), ["slice", "type", "i", "field"]).select("slice", "type", "i", "method", "field")


def cohesion(types: DataFrame, fields: DataFrame, methods: DataFrame, uses: DataFrame, slices: int) -> DataFrame:
    """MT5 and MT6 as metrics.cohesion gives them, worked in slices: a type of very many methods is in many of them."""
    sized, pairs = cohesion_pairs(types, fields, methods, uses, slices)
    c = pairs.groupBy("slice", "type").agg(F.count("*").alias("c")).groupBy("type").agg(F.sum("c").alias("c"))
    return metrics.cohesion_values(sized.join(c, "type", "left").fillna(0, ["c"]))
