"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics of whole texts are standardised by the training rows' means and deviations.  Random cosine features
approximate a Gaussian kernel on them; each partition adds up its rows' normal equations (one matrix for each of
FOLDS folds), the sums are summed in a tree, and the driver solves systems of fixed size.  The isotonic map is fitted
to scores that other folds' solutions give, over a histogram of BINS bins.

Defined results: null and empty texts have statistics of zero and are scored like any other.  Without training rows
every score is 0.5.  Rows with a null label don't train; a document labelled more than once, or occurring more than
once, trains once for each pair.  Repeated rows are scored each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes, _scratch
from .language_id import remainder

FEATURES = 192
FOLDS = 3
RIDGE = 1e-3
BINS = 2048
FEW = 4
WIDTH = 3.0
SEED = 20
N_STATS = 24

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 prose mark, 5 symbol, 6 space, 7 first byte beyond ASCII, 8 the bytes after it
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[33:127][_CLASS[33:127] == 0] = 1, 2, 3, 5
for _c in b".,;:!?'\"()-":
    _CLASS[_c] = 4
_CLASS[[32, 9, 10, 11, 12, 13]], _CLASS[192:], _CLASS[128:192] = 6, 7, 8


def _stats(buf: np.ndarray, st: np.ndarray, en: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of each document of a group: rows of N_STATS numbers."""
    n = len(first) - 1
    doc_words = np.diff(first)
    size = np.diff(offsets)
    doc_of_byte = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc_of_byte * 9 + _CLASS[buf], minlength=n * 9).reshape(n, 9).astype(float)
    chars = np.maximum(size - kinds[:, 8], 1)
    doc = np.repeat(np.arange(n), doc_words)
    length = (en - st).astype(float)
    words = np.maximum(doc_words, 1)
    mean = lambda x: np.bincount(doc, weights=x, minlength=n) / words
    h = _bytes.word_hashes(buf, st, en)
    keys = np.unique((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    distinct = np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=n)
    first_kind, last_kind = _CLASS[buf[st]], _CLASS[buf[en - 1]]
    line_end = buf == 10
    lines = np.bincount(doc_of_byte[line_end], minlength=n) + 1.0
    long = np.zeros(n)
    np.maximum.at(long, doc, length)
    m = mean(length)
    repeated = np.zeros(len(h), bool)
    if len(h) > 1:
        repeated[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    # words that come twice as a pair with the word after them
    pair = h[:-1] * np.uint64(3) + h[1:] if len(h) > 1 else h[:0]
    pd = doc[:-1][doc[:-1] == doc[1:]] if len(h) > 1 else doc[:0]
    pk = np.unique((pd.astype(np.uint64) << np.uint64(40)) | (_bytes.mix(pair[doc[:-1] == doc[1:]]) >> np.uint64(24))) if len(pd) else np.zeros(0, np.uint64)
    pairs = np.bincount((pk >> np.uint64(40)).astype(np.int64), minlength=n)
    out = np.stack([
        np.log1p(size), np.log1p(doc_words), np.log1p(lines),
        *(kinds[:, k] / chars for k in (1, 2, 3, 4, 5, 6, 7)), kinds[:, 0] / chars,
        m, np.sqrt(np.maximum(mean(length**2) - m**2, 0)), np.log1p(long),
        distinct / words, pairs / words, mean(repeated), mean(first_kind == 2), mean(last_kind == 4), mean(last_kind == 5), mean((st + 1 == en) & (first_kind == 5)), mean(length <= 3),
        np.log1p(doc_words / lines), np.bincount(doc_of_byte[buf == 33], minlength=n) / words,
    ], axis=1)
    out[doc_words == 0, 3:] = 0
    return out


def statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and stats (array of N_STATS doubles) of each row."""

    def run(batches):
        for batch in batches:
            _, offsets = _bytes.buffers(batch.column(1))
            for i, j, buf, st, en, first in _bytes.documents(batch.column(1), _bytes.NONSPACE):
                s = _stats(buf, st, en, first, offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, N_STATS, dtype=np.int32)), pa.array(s.ravel()))], names=["doc_id", "stats"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(_bytes.tidy(run), "doc_id long, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Kernel:
    """Standardised statistics, their random Fourier features, and 1."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(size=(len(mean), features)) / (width * np.sqrt(len(mean) / 8))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), z / 10, np.ones((len(z), 1))], axis=1)


def _sum_up(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for fold, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(m.as_buffer(), np.float64)
            total[fold] = total[fold] + x if fold in total else x.copy()
    for fold, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["fold", "sums"])


def fit(train: DataFrame) -> dict:
    """Model from rows of stats, label (0 or 1) and fold (0 to FOLDS - 1)."""
    spark = train.sparkSession
    cols = [f(F.col("stats")[i]).alias(f"{name}{i}") for i in range(N_STATS) for name, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = train.agg(F.count("*").alias("n"), *cols).first()
    if not row["n"]:
        return {"kernel": None}
    kernel = Kernel(np.array([row[f"m{i}"] for i in range(N_STATS)]), np.array([row[f"s{i}"] for i in range(N_STATS)]))
    sent = spark.sparkContext.broadcast(kernel)

    def equations(batches):
        phi, total = sent.value, {}
        for batch in batches:
            if not len(batch):
                continue
            x, y, fold = phi(_matrix(batch.column(0))), batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy()
            for f in np.unique(fold):
                both = np.concatenate([x[fold == f], y[fold == f, None]], axis=1)
                total[int(f)] = total.get(int(f), 0) + both.T @ both
        for f, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["fold", "sums"])

    # a tree of sums: of each partition, of about the square root of their number, of FEW
    rows = train.select("stats", "label", "fold")
    parts = rows.rdd.getNumPartitions()
    sums = rows.mapInArrow(_bytes.tidy(equations), "fold int, sums binary")
    for n in [int(parts**0.5)] * (parts > FEW**2) + [FEW]:
        sums = sums.repartition(n).mapInArrow(_sum_up, "fold int, sums binary")
    d = FEATURES + N_STATS + 2
    by_fold: dict[int, np.ndarray] = {}
    for r in sums.collect():  # at most FEW matrices a fold
        by_fold[r["fold"]] = by_fold.get(r["fold"], 0) + np.frombuffer(bytes(r["sums"]), np.float64).reshape(d, d)
    whole = sum(by_fold.values())

    def solve(m):
        a = m[:-1, :-1] + RIDGE * max(m[-2, -2], 1.0) * np.eye(d - 1) / (d - 1)
        return np.linalg.solve(a, m[:-1, -1])

    weights = solve(whole)
    left_out = {f: solve(whole - m) if whole[-2, -2] > m[-2, -2] else weights for f, m in by_fold.items()}
    table = np.stack([left_out.get(f, weights) for f in range(FOLDS)])
    held = spark.sparkContext.broadcast(table)

    def bins(batches):
        phi = sent.value
        n, s = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if len(batch):
                raw = (phi(_matrix(batch.column(0))) * held.value[batch.column(2).to_numpy()]).sum(axis=1)
                k = _bin(raw)
                n += np.bincount(k, minlength=BINS)
                s += np.bincount(k, weights=batch.column(1).to_numpy().astype(float), minlength=BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(s[at])], names=["bin", "n", "s"])

    got = train.select("stats", "label", "fold").mapInArrow(_bytes.tidy(bins), "bin int, n double, s double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("bin").collect()
    return {"kernel": kernel, "weights": weights, "map": isotonic([(r["bin"] + 0.5) / BINS * 2 - 0.5 for r in got], [r["n"] for r in got], [r["s"] for r in got])}


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def isotonic(x: list[float], n: list[float], s: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and means of the blocks, both rising."""
    blocks: list[list[float]] = []  # weight, sum of labels, sum of weight * x
    for xi, ni, si in zip(x, n, s, strict=True):
        blocks.append([ni, si, ni * xi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def score(stats: DataFrame, model: dict) -> DataFrame:
    """Adds score to rows of stats."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            if m["kernel"] is None or not len(batch):
                out = np.full(len(batch), 0.5)
            else:
                out = np.clip(np.interp(m["kernel"](_matrix(batch.column(1))) @ m["weights"], *m["map"]), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(_bytes.tidy(run), "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, trains, label_col: str = "quality") -> DataFrame:
    """doc_id and score of every document, learned from labelled documents for whose doc_id `trains` holds."""
    _bytes.modest(documents.sparkSession)
    stats = _scratch.saved(statistics(documents), "stats")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where(F.col("label").isNotNull())
    train = stats.where(trains("doc_id")).join(known, "doc_id")
    train = _scratch.saved(train.select("stats", "label", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "train")
    return score(stats, fit(train))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Learns from labels of documents of remainder 0 and 2 modulo 3, scores all."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = classify(docs, labels, lambda c: remainder(c, 3) != 1)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
