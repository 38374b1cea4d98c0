"""Vector codes by product quantisation: Lloyd's rounds with Hamerly's bounds, all in whole numbers.

Components become floor(scale * x).  Each of PARTS consecutive parts of a vector has a codebook of ENTRIES entries that
starts as that part of the vectors with the smallest ids.  A round assigns every part to its nearest entry (squared
Euclidean distance, ties to the lower index) and moves each entry to the floored mean of its parts.

Each part of each vector keeps one upper bound of the distance to its entry and one lower bound of the distance to the
second nearest.  When entries move, the upper bound grows by the own entry's move and the lower bound falls by the
largest move of another.  A part is compared with all entries, in whole numbers, only if its upper bound, made exact, is
not strictly below the lower bound (or below half the distance from its entry to the next one); strictly, so that a tie
is always settled by a whole scan.  Bounds are doubles rounded away from the truth.

Every round reads the table that the last one stored in the shared folder and writes its own, with the vectors, their
codes and bounds; each task adds a row with the sums of its parts by entry, and Spark adds those up.  What the driver
holds is the codebooks.

Defined results: rows without an id, and rows whose vector is null, empty, or holds a null, NaN or infinite component,
are left out; so are vectors of another dimension than that of the smallest id.  If ids repeat, each id starts one entry
(its lexicographically smallest vector), and every row is coded.  A dimension that PARTS doesn't divide gives parts that
differ by one component.  Fewer ids than ENTRIES give fewer entries.  Components beyond 64 bits, and errors and sums of
errors beyond them, become the largest or smallest 64-bit integer.  Empty tables give no rows.  Other columns than id,
vector and label are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes, _scratch

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096.0
#: Labels whose sums are sent out; more are joined, dealt over SALTS keys each.
FEW_LABELS, SALTS = 10_000, 32
MOST = (1 << 63) - 1
#: Relative room for the rounding of bounds.
ROOM = 1e-12


def whole(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: float = SCALE) -> DataFrame:
    """id, label, x (array of long) of the rows that take part, whatever their dimension."""
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where((F.size("x") > 0) & finite)
    return rows.withColumn("x", F.transform("x", lambda x: F.floor(F.lit(scale) * x)))


def _exact(most: int, dim: int) -> bool:
    """Squared distances of such components, and their sums over a vector, fit in 64 bits."""
    return 4 * most * most * dim < MOST


def _wide(x: np.ndarray) -> np.ndarray:
    return x.astype(object)


def _largest(*arrays: np.ndarray) -> int:
    return max((max(-int(a.min()), int(a.max())) for a in arrays if a.size), default=0)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x and y, which fit each other."""
    d = x - y
    return (d * d).sum(axis=-1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Books:
    """Codebooks: of each part an array of entries, with moves since the last round and distances between entries."""

    def __init__(self, entries: list[np.ndarray], before: Books | None = None):
        self.entries, self.parts = entries, len(entries)
        self.most = _largest(*entries)
        self.moves, self.gaps = [], []
        for p, e in enumerate(entries):
            w = _wide(e)
            k = len(e)
            between = np.array([[_root(np.array([_squares(a, b)]))[0] if i != j else np.inf for j, b in enumerate(w)] for i, a in enumerate(w)]).reshape(k, k)
            self.gaps.append(between.min(axis=1, initial=np.inf) / 2 * (1 - ROOM))
            move = np.zeros(k) if before is None else np.array([_root(np.array([_squares(a, b)]))[0] for a, b in zip(w, _wide(before.entries[p]), strict=True)]) * (1 + ROOM)
            other = np.array([max((m for j, m in enumerate(move) if j != i), default=0.0) for i in range(k)])
            self.moves.append((move, other))

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(c)) for e in self.entries for row in e for c in row).encode()).hexdigest()


def cuts(dim: int, parts: int = PARTS) -> list[int]:
    return [p * dim // parts for p in range(parts + 1)]


def assign(x: np.ndarray, books: Books, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Brings code and bounds (rows x parts) up to date in place; a first round has code -1.  Number of whole scans."""
    at, scans = cuts(x.shape[1], books.parts), 0
    exact = _exact(max(books.most, _largest(x)), x.shape[1])
    for p, entries in enumerate(books.entries):
        xs, es = (v if exact else _wide(v) for v in (x[:, at[p] : at[p + 1]], entries))
        own, u, low = code[:, p], upper[:, p], lower[:, p]
        new = own < 0
        kept = np.where(new, 0, own)
        move, other = books.moves[p]
        u[:] = np.where(new, np.inf, (u + move[kept]) * (1 + ROOM))
        low[:] = np.where(new, -np.inf, low - other[kept] - ROOM * (np.abs(low) + other[kept]))
        gap = books.gaps[p][kept]
        todo = np.flatnonzero(new | ~((u < low) | (u < gap)))
        if len(todo):
            old = todo[~new[todo]]
            u[old] = _root(_squares(xs[old], es[own[old]])) * (1 + ROOM)
            todo = todo[new[todo] | ~((u[todo] < low[todo]) | (u[todo] < gap[todo]))]
        if not len(todo):
            continue
        scans += len(todo)
        d = np.stack([_squares(xs[todo], e[None, :]) for e in es], axis=1)
        best = d.argmin(axis=1)
        own[todo] = best
        u[todo] = _root(d[np.arange(len(todo)), best]) * (1 + ROOM)
        if len(es) > 1:
            f = d.astype(np.float64)
            f[np.arange(len(todo)), best] = np.inf
            low[todo] = np.sqrt(f.min(axis=1)) * (1 - ROOM)
        else:
            low[todo] = np.inf
    return scans


def errors(x: np.ndarray, books: Books, code: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to its entries."""
    at = cuts(x.shape[1], books.parts)
    if _exact(max(books.most, _largest(x)), x.shape[1]):
        return sum((_squares(x[:, at[p] : at[p + 1]], e[code[:, p]]) for p, e in enumerate(books.entries)), np.zeros(len(x), np.int64))
    w = _wide(x)
    total = sum((_squares(w[:, at[p] : at[p + 1]], _wide(e)[code[:, p]]) for p, e in enumerate(books.entries)), _wide(np.zeros(len(x), np.int64)))
    return np.minimum(total, MOST).astype(np.int64)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(m).ravel()))


def _round(table: DataFrame, books: Books) -> DataFrame:
    """The next state: rows with sums null, and one of each task with its sums and counts by part and entry alone."""
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast(books)
    label_kind = table.schema["label"].dataType

    def run(batches):
        b, sums, kinds = sent.value, None, None
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(2), np.int64)
            code, upper, lower = (_matrix(batch.column(i), k) for i, k in ((3, np.int64), (4, float), (5, float)))
            assign(x, b, code, upper, lower)
            at, kinds = cuts(x.shape[1], b.parts), batch.schema.field(1).type
            small = _largest(x) < (MOST >> 32)
            sums = sums or [(np.zeros((len(e), e.shape[1]), object), np.zeros(len(e), np.int64)) for e in b.entries]
            for p, (total, n) in enumerate(sums):
                for k in range(len(n)):
                    mine = x[code[:, p] == k, at[p] : at[p + 1]]
                    n[k] += len(mine)
                    total[k] += mine.sum(axis=0).astype(object) if small else _wide(mine).sum(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _lists(code.astype(np.int16)), _lists(upper), _lists(lower), pa.nulls(len(x), pa.list_(pa.decimal128(38, 0))), pa.array(np.zeros(len(x), np.int32))], names=NAMES)
        if sums:
            flat = [Decimal(int(v)) for total, n in sums for k in range(len(n)) for v in (n[k], *total[k])]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, kinds), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int16())), *[pa.nulls(1, pa.list_(pa.float64()))] * 2, pa.array([flat], pa.list_(pa.decimal128(38, 0))), pa.array([1], pa.int32())], names=NAMES)

    return table.mapInArrow(_bytes.tidy(run), f"id long, label {label_kind.simpleString()}, {STATE}, sums array<decimal(38,0)>, kind int")


NAMES = ["id", "label", "x", "code", "upper", "lower", "sums", "kind"]
STATE = "x array<long>, code array<smallint>, upper array<double>, lower array<double>"


def moved(stored: DataFrame, books: Books) -> Books:
    """The codebooks after a round: floored means of the parts of each entry, or the entry itself if it has none."""
    parts = stored.where("kind = 1").select(F.posexplode("sums").alias("at", "v"))
    total = dict(parts.groupBy("at").agg(F.sum("v").alias("v")).collect())  # a row for each number of the codebooks
    out, i = [], 0
    for e in books.entries:
        new = e.copy()
        for k in range(len(e)):
            n, sums = int(total.get(i, 0)), [int(total.get(i + 1 + c, 0)) for c in range(e.shape[1])]
            i += 1 + e.shape[1]
            if n:
                new[k] = [s // n for s in sums]
        out.append(new)
    return Books(out, books)


def compressed(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> DataFrame:
    """id, label, code (array of entry numbers by part), error, codebooks_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    rows = whole(vectors, id_col, vec_col, label_col, scale)
    ids = [r["id"] for r in rows.select("id").distinct().orderBy("id").limit(entries).collect()]
    seeds = rows.where(F.col("id").isin(ids) if ids else F.lit(False)).groupBy("id").agg(F.min("x").alias("x")).orderBy("id").collect()  # ENTRIES vectors
    dim = len(seeds[0]["x"]) if seeds else 1
    first = np.array([r["x"] for r in seeds if len(r["x"]) == dim], np.int64).reshape(-1, dim)
    at = cuts(dim, parts)
    books = Books([first[:, a:b].copy() for a, b in zip(at, at[1:], strict=False)])
    none = lambda kind, v: F.array_repeat(F.lit(v).cast(kind), parts)
    state = rows.where(F.size("x") == dim).select("id", "label", "x", none("smallint", -1).alias("code"), none("double", 0).alias("upper"), none("double", 0).alias("lower"))
    path = None
    for _ in range(rounds):
        stored, new = _scratch.save(_round(state, books), "codes", "zstd", "kind")
        if path:
            _scratch.drop(spark, path)
        path, books = new, moved(stored, books)
        state = stored.where("kind = 0").select(*NAMES[:6])
    sent, digest = spark.sparkContext.broadcast(books), books.digest()

    def final(batches):
        b = sent.value
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(2), np.int64)
                code, upper, lower = (_matrix(batch.column(i), k) for i, k in ((3, np.int64), (4, float), (5, float)))
                assign(x, b, code, upper, lower)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(code.astype(np.int16)), pa.array(errors(x, b, code))], names=["id", "label", "code", "error"])

    out = state.mapInArrow(_bytes.tidy(final), f"id long, label {state.schema['label'].dataType.simpleString()}, code array<smallint>, error long")
    done = _scratch.saved(out, "coded")
    if path:
        _scratch.drop(spark, path)
    return done.withColumn("codebooks_sha256", F.lit(digest))


def label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: the error summed over rows of equal label, nulls together.

    Sums have a row for each label: sent out if they are few; else joined with the rows dealt over salts, so that a
    frequent label is no single task's."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_label")
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_s") == F.col("_salt"))).drop("_label", "_salt", "_s")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """All embeddings, 8 parts of 16 entries, 6 rounds."""
    out = label_errors(compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")
    return out.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""
d{r} AS (
  SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d
  FROM x JOIN b{r} b ON b.part = x.part AND b.pos = x.pos GROUP BY ALL
), a{r} AS MATERIALIZED (
  SELECT vec_id, part, entry, d FROM d{r}
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1
)""")
        if r < ROUNDS:
            rounds.append(f"""
b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN (
    SELECT a.part, a.entry, x.pos, CAST(floor(CAST(sum(x.v) AS DOUBLE) / count(*)) AS BIGINT) AS v
    FROM a{r} a JOIN x ON x.vec_id = a.vec_id AND x.part = a.part GROUP BY ALL
  ) m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos
)""")
    return f"""
WITH e AS (
  SELECT vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0
), x AS MATERIALIZED (
  SELECT vec_id, i * {PARTS} // len(v) AS part, i % (len(v) // {PARTS}) AS pos, CAST(floor(4096 * CAST(v[i + 1] AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT vec_id, v, unnest(range(len(v))) AS i FROM e)
), b0 AS MATERIALIZED (
  SELECT x.part, s.entry, x.pos, x.v
  FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM e ORDER BY vec_id LIMIT {ENTRIES})) s JOIN x ON x.vec_id = s.vec_id
),{",".join(rounds)}, r AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY vec_id
)
SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY e.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{ROUNDS}) AS codebooks_sha256
FROM r JOIN e ON e.vec_id = r.vec_id
"""


OP12_SQL = _sql()
