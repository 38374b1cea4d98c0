"""Exact top-k search by integer inner product: tiled matrix products, partial selection per tile, tree merging.

Components become floor(scale * x).  Queries are stored once, dealt into blocks of a fixed number of components; every
block is sent to the executors and meets every row (a stated query set against all rows), so what is sent at once is
bounded whatever the table's size.  A block's lists are stored before the next block is read, so the plan doesn't grow
with the queries.

Defined results: vectors that are null, or hold a null, NaN or infinite component, neither ask nor answer.  Vectors of
another dimension than the query's are not its candidates.  Rows that share the query's id count as its own.  Query rows
that share an id are queries of their own: each has its own ranks.  Repeated candidate rows each take a rank; equal
scores go to the smaller id.  Scores beyond 64 bits become the largest or smallest 64-bit integer.  An empty table gives
no rows.  Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _scratch

#: Components of queries sent out at once: 2 M doubles are 16 MB.
BLOCK_COMPONENTS = 2 << 20
#: Scores held by one tile: 4 M doubles are 32 MB.
TILE_SCORES = 4 << 20
_EXACT = float(1 << 53)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite)


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows by dimension: {dim: (row numbers, matrix)}."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, offs = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    out = {}
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        out[int(dim)] = rows, flat[(offs[rows][:, None] + np.arange(dim)[None, :])].reshape(len(rows), int(dim))
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; float64 products while every partial sum is below 2^53, else Python integers."""
    dim = q.shape[1]
    most = (np.abs(q).max() if q.size else 0) * (np.abs(x).max() if x.size else 0) * max(dim, 1)
    if most < _EXACT:
        return (q @ x.T).astype(np.int64)
    big = np.array([[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q], dtype=object)
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best of a tile; ties at the border are settled by id."""
    take = ids[None, :] != own[:, None]
    if scores.shape[1] > k + 1 and np.abs(scores).max() < _EXACT:
        # own rows count as worst; every score equal to the k-th best stays, for ids to settle
        masked = np.where(take, -scores, np.inf)
        take &= -scores <= np.partition(masked, k - 1, axis=1)[:, k - 1, None]
    r, c = np.nonzero(take)
    s, v = scores[r, c], ids[c]
    order = np.lexsort((v, -s, r))
    r, s, v = r[order], s[order], v[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r, side="left")
    keep = rank < k
    return r[keep], v[keep], s[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Each query's k best rows of `vectors`: query_id, rank, id, score."""
    spark = vectors.sparkSession
    ints = lambda df: usable(df, id_col, vec_col).select("id", F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("double")).alias("v"))
    base = ints(vectors)
    asked = ints(queries)
    dims = asked.select(F.max(F.size("v")).alias("d"), F.count("*").alias("n")).first()
    blocks = -(-dims["n"] // max(1, BLOCK_COMPONENTS // max(1, dims["d"] or 1)))
    if blocks <= 1:
        out = _block(spark, base, asked, k, 0)
    else:
        path = None
        deal = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block")
        stored, _ = _scratch.save(asked.select("*", deal).repartition("block"), "queries", "snappy", "block")
        for b in range(blocks):
            path = _scratch.append(_merged(_block(spark, base, stored.where(F.col("block") == b), k, b), k), "lists", path)
        out = spark.read.parquet(path)
    return _merged(out, k, 64).select(F.col("query").getField("id").alias("query_id"), "rank", "id", "score")


def _merged(lists: DataFrame, k: int, parts: int = 0) -> DataFrame:
    """Tree merge: the lists of some tiles (by `parts` groups of partitions), then those of all."""
    for keys in ([["query", F.pmod(F.spark_partition_id(), F.lit(parts))]] if parts else []) + [["query"]]:
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
        lists = lists.drop("rank").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return lists


def _block(spark, base: DataFrame, block: DataFrame, k: int, number: int) -> DataFrame:
    """query (its block, row and id), id, score of the best of each partition."""
    got = block.select("id", "v").toArrow()  # BLOCK_COMPONENTS numbers
    ids = got["id"].to_numpy()
    by_dim = {d: (ids[rows], m, rows) for d, (rows, m) in (_matrix(got["v"].combine_chunks()) if len(ids) else {}).items()}
    sent = spark.sparkContext.broadcast(by_dim)

    def run(batches):
        asked, held = sent.value, {}

        def flush(d):
            rows = held.pop(d)
            r, v, s = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort((v, -s, r))
            r, v, s = r[order], v[order], s[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
            held[d] = [(r[keep], v[keep], s[keep])]

        for batch in batches:
            bid = batch.column(0).to_numpy()
            for d, (rows, x) in _matrix(batch.column(1)).items():
                if d not in asked:
                    continue
                qid, q, _ = asked[d]
                tile = max(1, TILE_SCORES // max(1, len(qid)))
                for at in range(0, len(rows), tile):
                    part = slice(at, at + tile)
                    held.setdefault(d, []).append(_best(_scores(q, x[part]), bid[rows[part]], qid, k))
                    if len(held[d]) > 16:
                        flush(d)
        for d in list(held):
            flush(d)
            r, v, s = held[d][0]
            qid, _, rows = asked[d]
            query = pa.StructArray.from_arrays([pa.array(np.full(len(r), number, np.int32)), pa.array(rows[r].astype(np.int64)), pa.array(qid[r])], names=["block", "nth", "id"])
            yield pa.RecordBatch.from_arrays([query, pa.array(v), pa.array(s)], names=["query", "id", "score"])

    return base.mapInArrow(run, "query struct<block: int, nth: long, id: long>, id long, score long")


def op7_topk_search(spark, sf_dir: str) -> DataFrame:
    """Queries: vec_id divisible by 50, against all rows."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = top_k(e, e.where(F.col("vec_id") % 50 == 0))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


OP7_SQL = """
WITH e AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
