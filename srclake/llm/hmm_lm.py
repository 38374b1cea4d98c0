"""Hidden Markov language model of whole texts, beside a unigram baseline with exact corpus counts.

Every word has a symbol: short words by their key, longer ones by their last three bytes.  The states emit symbols; a
word given its symbol has the add-one relative frequency of its corpus count among that symbol's words, so
p(text) = p(symbols) * product of p(word | symbol) sums to one over texts, all unknown words of a symbol counting as one.
Baum-Welch counts are summed across partitions in every round.  From a seeded start at the corpus's symbol frequencies,
START_ROUNDS rounds take another share of all chunks each, by a hash, and mix its counts into those of the rounds before
(stepwise EM); then ITERATIONS rounds take all chunks.  A chunk's number comes from its partition, so the shares, and with
them the scores (not base_score or the counts), depend on how the rows are partitioned.  What the states learn from grows
with the corpus.  The scaled forward recursion gives each text's exact likelihood.

Corpus counts: documents are stored as chunks, each with its distinct word keys.  Keys are dealt by ranges; each range
sums its counts over all chunks and sends them back to the chunks that asked.  A word takes one entry in a chunk,
however frequent, and a range's size follows from the input's, so neither a frequent word nor the vocabulary is
gathered in one place.

Defined results: null and empty texts are the end token alone.  Without training documents every count is 0.  A null
doc_id counts as training.  Repeated rows are documents of their own.  Empty tables give no rows; other columns are
ignored.  Words are compared by 64-bit keys of their lower-cased bytes, be
they UTF-8 or not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes, _scratch
from .language_id import remainder

STATES = 8
ITERATIONS = 2
START_ROUNDS = 8
SHORT = 5
SYMBOLS_SHORT = SYMBOLS_LONG = 1 << 14
SYMBOLS = 1 + SYMBOLS_SHORT + SYMBOLS_LONG
#: Weight, in tokens, of the corpus's symbol frequencies in each state's emissions.
PRIOR = 100.0
CHUNK_BYTES = 8 << 20
#: Input bytes for each range of keys.
RANGE_BYTES = 8 << 20
END = np.uint64(0x5DEECE66D1234567)
SEED = 7

CHUNKS = "chunk long, docs binary, null_id binary, held binary, first binary, idx binary, keys binary, n binary, sym binary"


def chunks(documents: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of whole documents: first token of each document, each token's number among the chunk's distinct keys,
    and of each key its count in training documents and its symbol."""

    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, out_held = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            data, offsets = _bytes.buffers(batch.column(2))
            for i, j in _bytes.groups(offsets, CHUNK_BYTES):
                n = j - i
                keys, syms, counts = [], [], np.zeros(n, np.int64)
                off = offsets[i : j + 1]
                for a, b in _bytes.groups(off):
                    buf = data[off[a] : off[b]]
                    st, en, first = _bytes.word_bounds(buf, off[a : b + 1] - off[a], _bytes.NONSPACE)
                    h = _bytes.word_hashes(buf, st, en)
                    low = _bytes.LOWER[buf].astype(np.uint64) if len(st) else np.zeros(1, np.uint64)
                    last = low[en - 1] | low[np.maximum(en - 2, 0)] << np.uint64(8) | low[np.maximum(en - 3, 0)] << np.uint64(16)
                    long = en - st > SHORT
                    keys.append(h)
                    syms.append(np.where(long, 1 + SYMBOLS_SHORT + _bytes.mix(last) % np.uint64(SYMBOLS_LONG), 1 + h % np.uint64(SYMBOLS_SHORT)).astype(np.uint16))
                    counts[a:b] = np.diff(first)
                h, sym = np.concatenate(keys), np.concatenate(syms)
                first = np.concatenate([[0], np.cumsum(counts + 1)])
                tok = np.empty(len(h) + n, np.uint64)
                tsym = np.zeros(len(tok), np.uint16)
                at = np.arange(len(h)) + np.repeat(np.arange(n), counts)
                tok[at], tsym[at] = h, sym
                tok[first[1:] - 1] = END
                uniq, where, idx = np.unique(tok, return_index=True, return_inverse=True)
                trains = np.repeat(~out_held[i:j], counts + 1)
                got = np.bincount(idx[trains], minlength=len(uniq))
                row = [ids[i:j], null[i:j].astype(np.uint8), out_held[i:j].astype(np.uint8), first.astype(np.uint32), idx.astype(np.uint32), uniq, got.astype(np.uint32), tsym[where]]
                yield pa.RecordBatch.from_arrays([pa.array([(part << 24) + nth], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in row)], names=["chunk", "docs", "null_id", "held", "first", "idx", "keys", "n", "sym"])
                nth += 1

    return documents.select(F.col(id_col).cast("long"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col)).mapInArrow(_bytes.tidy(run), CHUNKS)


def _get(row: dict, name: str, kind) -> np.ndarray:
    return np.frombuffer(row[name], kind)


def corpus_counts(stored: DataFrame, ranges: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Counts over all chunks: (chunk, range, counts of the chunk's keys in that range), and tokens and words of each
    symbol."""
    edges = [(k << 64) // ranges for k in range(1, ranges)]

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, n, sym = _get(row, "keys", np.uint64), _get(row, "n", np.uint32), _get(row, "sym", np.uint16)
                at = [0, *np.searchsorted(keys, np.array(edges, np.uint64)).tolist(), len(keys)]
                parts = [(k, a, b) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in parts], pa.int32()), pa.array([row["chunk"]] * len(parts), pa.int64()), *(pa.array([x[a:b].tobytes() for _, a, b in parts], pa.binary()) for x in (keys, n, sym))], names=["range", "chunk", "keys", "n", "sym"])

    def total(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([_get(r, "keys", np.uint64) for r in rows])
        uniq, where, inv = np.unique(keys, return_index=True, return_inverse=True)
        n = np.bincount(inv, weights=np.concatenate([_get(r, "n", np.uint32) for r in rows]), minlength=len(uniq)).astype(np.int64)
        sym = np.concatenate([_get(r, "sym", np.uint16) for r in rows])[where]
        tokens, words = np.bincount(sym, weights=n, minlength=SYMBOLS), np.bincount(sym[n > 0], minlength=SYMBOLS)
        at = np.cumsum([0, *(len(r["keys"]) // 8 for r in rows)])
        out = [(r["chunk"], r["range"], n[inv[a:b]].tobytes()) for r, a, b in zip(rows, at, at[1:], strict=False)]
        out.append((-1, rows[0]["range"], np.concatenate([tokens, words]).astype(np.int64).tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "range", "counts"])

    dealt = stored.select("chunk", "keys", "n", "sym").mapInArrow(_bytes.tidy(deal), "range int, chunk long, keys binary, n binary, sym binary")
    counts = _scratch.saved(dealt.groupBy("range").applyInArrow(total, "chunk long, range int, counts binary"), "counts")

    def add_up(batches):
        s = np.zeros(2 * SYMBOLS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                s += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], names=["s"])

    sums = sum((np.frombuffer(bytes(r["s"]), np.int64) for r in counts.where("chunk = -1").select("counts").coalesce(16).mapInArrow(_bytes.tidy(add_up), "s binary").collect()), np.zeros(2 * SYMBOLS, np.int64))
    return counts.where("chunk >= 0"), sums[:SYMBOLS], sums[SYMBOLS:]


class Hmm:
    """start (states), move (states x states), emit (symbols x states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def forward(self, sym: np.ndarray, first: np.ndarray, keep: bool = False):
        """log10 likelihood of each document; with keep also the scaled alphas and scales by token.

        Documents advance together, longest first, so each step is one small matrix product."""
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        f = first[:-1][order]
        active = np.searchsorted(-length[order], -np.arange(1, (length.max() if len(length) else 0) + 1), side="right")
        ll = np.zeros(len(length))
        alphas, scales = (np.empty((len(sym), len(self.start)), np.float32), np.empty(len(sym))) if keep else (None, None)
        a = None
        for t, n in enumerate(active.tolist()):
            tok = f[:n] + t
            a = (self.start[None, :] if a is None else a[:n] @ self.move) * self.emit[sym[tok]]
            c = a.sum(axis=1)
            a /= c[:, None]
            ll[:n] += np.log10(c)
            if keep:
                alphas[tok], scales[tok] = a, c
        out = np.empty(len(length))
        out[order] = ll
        return (out, order, active, alphas, scales) if keep else out

    def expected(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts of starts, moves and emissions, and the log10 likelihood."""
        ll, order, active, alphas, scales = self.forward(sym, first, keep=True)
        f, s = first[:-1][order], len(self.start)
        moves, beta = np.zeros((s, s)), np.ones((len(order), s))
        gamma = alphas  # at each document's last token alpha is gamma already
        n_next = 0
        for t in range(len(active) - 1, -1, -1):
            n = int(active[t])
            if n_next:
                nxt = f[:n_next] + t + 1
                w = self.emit[sym[nxt]] * beta[:n_next] / scales[nxt][:, None]
                tok = f[:n_next] + t
                moves += alphas[tok].T @ w
                beta[:n_next] = w @ self.move.T
                gamma[tok] = alphas[tok] * beta[:n_next]
            n_next = n
        moves *= self.move
        emits = np.stack([np.bincount(sym, weights=gamma[:, k], minlength=SYMBOLS) for k in range(s)], axis=1)
        return gamma[first[:-1]].sum(axis=0, dtype=float), moves, emits, float(ll.sum())


def maximised(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, overall: np.ndarray) -> Hmm:
    s = starts + 1.0
    m = moves + 1.0
    e = emits + PRIOR * overall[:, None]
    return Hmm(s / s.sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=0, keepdims=True))


def _training_tokens(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and first tokens of a chunk's training documents."""
    first = _get(row, "first", np.uint32).astype(np.int64)
    keep = _get(row, "held", np.uint8) == 0
    length = np.diff(first)
    sym = _get(row, "sym", np.uint16)[_get(row, "idx", np.uint32)[np.repeat(keep, length)]]
    return sym, np.concatenate([[0], np.cumsum(length[keep])])


def starting_point(overall: np.ndarray) -> Hmm:
    """A seeded start with slow moves: the corpus's symbol frequencies, with noise."""
    rng = np.random.default_rng(SEED)
    noise = rng.gamma(1.0, size=(SYMBOLS, STATES)) * overall[:, None]
    return Hmm(np.full(STATES, 1 / STATES), 0.9 * np.eye(STATES) + 0.1 / STATES, noise / noise.sum(axis=0))


def baum_welch(stored: DataFrame, hmm: Hmm, nth: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions over all training documents, or over those of the nth share of chunks."""
    if nth is not None:
        stored = stored.where(F.pmod(F.xxhash64("chunk"), F.lit(START_ROUNDS)) == nth)
    spark = stored.sparkSession
    sent = spark.sparkContext.broadcast(hmm)
    s = STATES

    def count(batches):
        small, emits = np.zeros(s + s * s), np.zeros((SYMBOLS, s))
        for batch in batches:
            for row in batch.to_pylist():
                sym, first = _training_tokens(row)
                if len(sym):
                    a, b, e, _ = sent.value.expected(sym, first)
                    small += np.concatenate([a, b.ravel()])
                    emits += e
        at = np.flatnonzero(emits.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (small, at.astype(np.uint16), emits[at])], names=["small", "at", "emits"])

    def add_up(batches):
        small, emits = np.zeros(s + s * s), np.zeros((SYMBOLS, s))
        for batch in batches:
            for row in batch.to_pylist():
                small += _get(row, "small", np.float64)
                emits[_get(row, "at", np.uint16)] += _get(row, "emits", np.float64).reshape(-1, s)
        at = np.flatnonzero(emits.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (small, at.astype(np.uint16), emits[at])], names=["small", "at", "emits"])

    kind = "small binary, at binary, emits binary"
    parts = stored.select("first", "held", "idx", "sym").mapInArrow(_bytes.tidy(count), kind).repartition(8).mapInArrow(_bytes.tidy(add_up), kind).collect()
    small, emits = np.zeros(s + s * s), np.zeros((SYMBOLS, s))
    for r in parts:
        small += np.frombuffer(bytes(r["small"]), np.float64)
        emits[np.frombuffer(bytes(r["at"]), np.uint16)] += np.frombuffer(bytes(r["emits"]), np.float64).reshape(-1, s)
    return small[:s], small[s:].reshape(s, s), emits


def score(documents: DataFrame, held_out: Column, iterations: int = ITERATIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = documents.sparkSession
    ranges = max(1, min(1 << 14, _scratch.input_bytes(documents) // RANGE_BYTES))
    stored = _scratch.saved(chunks(documents, held_out, id_col, text_col), "chunks")
    counts, tokens, words = corpus_counts(stored, ranges)
    overall = (tokens + 1.0) / (tokens.sum() + SYMBOLS)
    hmm = starting_point(overall)
    held = None
    for k in range(START_ROUNDS):
        new = [START_ROUNDS * x for x in baum_welch(stored, hmm, k)]
        if not new[0].any():
            continue  # a share without training documents
        step = (k + 2) ** -0.7
        held = new if held is None else [(1 - step) * a + step * b for a, b in zip(held, new, strict=True)]
        hmm = maximised(*held, overall)
    for _ in range(iterations):
        hmm = maximised(*baum_welch(stored, hmm), overall)
    within = np.log10(tokens + words + 1.0)  # of a symbol
    every = np.log10(float(tokens.sum() + words.sum() + 1))
    n_train = int(tokens.sum())
    sent = spark.sparkContext.broadcast((hmm, within))

    def run(batches):
        model, under = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                got = sorted(row["got"], key=lambda r: r["range"])
                c = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in got])
                idx, first, dsym = _get(row, "idx", np.uint32), _get(row, "first", np.uint32).astype(np.int64), _get(row, "sym", np.uint16)
                up = np.log10(c + 1.0)
                base = np.add.reduceat((up - every)[idx], first[:-1])
                word = np.add.reduceat((up - under[dsym])[idx], first[:-1])
                known = np.add.reduceat((c > 0)[idx].astype(np.int64), first[:-1])
                n = np.diff(first)
                cols = [pa.array(_get(row, "docs", np.int64), pa.int64(), mask=_get(row, "null_id", np.uint8) > 0), pa.array(_get(row, "held", np.uint8) > 0), pa.array(n), pa.array(known), pa.array(np.full(len(n), n_train)), pa.array(base), pa.array(word + model.forward(dsym[idx], first))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    by_chunk = counts.groupBy("chunk").agg(F.collect_list(F.struct("range", "counts")).alias("got"))  # `ranges` rows at most
    both = stored.select("chunk", "docs", "null_id", "held", "first", "idx", "sym").join(by_chunk, "chunk")
    return both.drop("chunk").mapInArrow(_bytes.tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_hmm_lm(spark, sf_dir: str) -> DataFrame:
    """Learns from documents whose remainder modulo 7 isn't 2, scores all."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), remainder("doc_id", 7) == 2)
