"""Connected components of a link table, with DataFrame operations only.

Each round, every node with a smaller neighbour hooks to its smallest one; pointer jumping turns the forest into stars;
links are contracted to the stars' centres and made distinct.  A node's final component is the smallest id it reaches.
Rounds and jumps grow with the logarithm of the longest path.  Every table is stored in the shared folder, and minima
are pre-aggregated before the shuffle, so a hub with very many links is no group in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long; in any order, repeated, equal or null: ignored) -> id, component for each linked node."""
    spark = links.sparkSession
    old: list[str] = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        out, path = _scratch.save(df, tag, "snappy")
        old.append(path)
        return out

    pairs = lambda a, b: [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]
    live = keep(links.where("a <> b").select(*pairs("a", "b")).distinct(), "links")
    nodes = live.select(F.col("lo").alias("id")).unionByName(live.select(F.col("hi").alias("id"))).distinct()
    labels = None
    while not live.isEmpty():
        roots = keep(live.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("root")), "hooks")
        while True:
            up = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
            jumped = keep(roots.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jumps")
            roots = jumped.select("id", "root")
            if jumped.where("moved").isEmpty():
                break
        ends = live
        for end in ("lo", "hi"):
            r = roots.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
            ends = ends.join(r, end, "left").withColumn(end, F.coalesce(f"{end}_root", end)).select("lo", "hi")
        live = keep(ends.where("lo <> hi").select(*pairs("lo", "hi")).distinct(), "links")
        if labels is None:
            labels = roots
        else:
            r = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
            moved = labels.join(r, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
            # centres of earlier stars that hook only now were no rows of labels yet
            labels = moved.unionByName(roots.join(labels.select("id"), "id", "left_anti"))
            labels = keep(labels, "labels")
    if labels is None:
        labels = spark.createDataFrame([], "id long, root long")
    out, _ = _scratch.save(nodes.join(labels, "id", "left").select("id", F.coalesce("root", "id").alias("component")), "components", "snappy")
    _scratch.drop(spark, *old)
    return out
