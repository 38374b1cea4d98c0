"""Work slices: equal cost, whatever the skew; results as without slices."""

import math

import pytest
from pyspark.sql import functions as F

from srclake.operators import metrics, slices


def test_cost_classes_are_in_order(spark):
    costs = [*range(300), 1 << 40, (1 << 62) + 5, None, -3]
    got = {r["c"]: r["k"] for r in spark.createDataFrame([(c,) for c in costs], "c long").select("c", slices.cost_class("c").alias("k")).collect()}
    assert got[None] == got[-3] == got[0] == 0
    whole = [got[c] for c in range(300)]
    assert whole == sorted(whole)
    for low, high in ((4, 5), (64, 80), (100, 111)):  # at most a quarter apart
        assert (got[low] == got[high - 1]) or got[low] + 1 == got[high - 1]
    assert got[64] < got[80] < got[96] < got[112] < got[128] < got[1 << 40] < got[(1 << 62) + 5]


@pytest.mark.parametrize("block", [7, 100_000])
@pytest.mark.parametrize("n", [1, 3, 8])
def test_deal(spark, block, n):
    cost = [1000, 900, 5, 0, None, *(i * i % 97 for i in range(400)), *([30] * 200)]  # a third of the tasks cost the same
    t = spark.createDataFrame(list(enumerate(cost)), "id long, cost long").repartition(5)
    got = slices.deal(t, ["id"], "cost", n, block).collect()
    assert sorted(r["id"] for r in got) == list(range(len(cost)))
    tasks, load = [0] * n, [0] * n
    for r in got:
        tasks[r["slice"]] += 1
        load[r["slice"]] += r["cost"] or 0
    assert max(tasks) - min(tasks) <= 1
    assert max(load) - min(load) <= 2 * 1000
    assert sorted(got) == sorted(slices.deal(t.repartition(2), ["id"], "cost", n, block).collect())  # any layout


def test_deal_empty_and_wrong(spark):
    assert slices.deal(spark.createDataFrame([], "id long, cost long"), ["id"], "cost", 4).collect() == []
    with pytest.raises(ValueError, match="at least one"):
        slices.deal(spark.createDataFrame([(1, 1)], "id long, cost long"), ["id"], "cost", 0)


def _skewed(spark):
    """Type 0 has over half of all methods; 60 small ones; a type without fields, one without methods."""
    methods = [(0, m) for m in range(400)] + [(t, 1000 * t + m) for t in range(1, 61) for m in range(1 + t % 9)] + [(61, 99_001)]
    fields = [(0, f) for f in range(60)] + [(t, f) for t in range(1, 61) for f in range(1 + t % 7)] + [(62, 1)]
    uses = [(m, f) for t, m in methods for s, f in fields if s == t and (m * 7 + f * 3) % 4] + [(5, 4711), (1, 1), (1, 1)]
    df = lambda rows, kind: spark.createDataFrame(rows, kind).repartition(3)
    types = df([(t,) for t in range(63)] * 2, "type long")
    return types, df(fields * 2, "type long, field long"), df(methods, "type long, method long"), df(uses, "method long, field long")


@pytest.mark.parametrize("n", [1, 8])
def test_cohesion_in_slices(spark, n):
    x = _skewed(spark)
    same = lambda df: {r["type"]: (r["loc"], "nan" if math.isnan(r["loc_hs"]) else r["loc_hs"]) for r in df.collect()}
    got = same(slices.cohesion(*x, n))
    assert len(got) == 63
    assert got == same(metrics.cohesion(*x))


def test_largest_slice_is_near_the_mean(spark):
    """By cost, and by the rows that the partitions get, at most 1.5 times the mean; by whole types it would be 5 times."""
    types, fields, methods, uses = _skewed(spark)
    cut = slices.grids(metrics.type_sizes(types, fields, methods), 8)
    assert cut.where("a > 1 OR b > 1").count() <= 8 * slices.TILES
    load = [r["c"] for r in slices.tiles_of(cut, 8).groupBy("slice").agg(F.sum("cost").alias("c")).collect()]
    assert len(load) == 8
    assert max(load) <= 1.5 * sum(load) / 8
    _, pairs = slices.cohesion_pairs(types, fields, methods, uses, 8)
    rows = {(r["p"], r["slice"]): r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p"), "slice").count().collect()}
    assert len(rows) == 8
    assert max(rows.values()) <= 1.5 * sum(rows.values()) / 8


def test_pairs_are_joined_where_they_lie(spark):
    """No exchange between the slices' join and the sum by type within them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, pairs = slices.cohesion_pairs(*_skewed(spark), 8)
        plan = pairs.groupBy("slice", "type").agg(F.count("*").alias("c"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan[: plan.index("direct_shuffle_partition_id")].rsplit("Exchange", 1)[0]
