"""Quality rules: counts of repeats and symbols, and bands of n-gram perplexity for each language.

The model is a modified Kneser-Ney model of ORDER bytes over the bytes of whole texts, as they are; a text begins after
ORDER - 1 line breaks.  (Words would need a table of nearly as many trigrams as the corpus has words; byte grams are few
however much text there is.)  A gram of up to 7 bytes is its own 64-bit key.  Spark counts the grams of all documents:
each task adds up its own, the rest is one shuffle of distinct grams.  Lower orders count distinct grams of the next
order by their last bytes; discounts come from the counts of counts of each order; probabilities are joined from order 1
up, so the model is a set of tables that no process has to hold.

For scoring, the probabilities of the corpus's grams become sorted arrays of keys and fixed-point logarithms, which
tasks search.  An array holds SLICE keys at most; a larger model is scored slice by slice, each a pass over the texts,
and the sums are added by text.  Sums are whole numbers, so scores don't depend on the partitions.

A document's perplexity is 2 ** bits, bits being the mean of -log2 p a byte.  A language's band goes from its first
quartile of bits less its reach to its third quartile and as much more.  The reach is SPREAD times the distance of the
quartiles (MIN_DISTANCE at least), and sqrt(1 + SHORT / bytes) times as wide for a text of so many bytes, whose mean is
that much less certain.  Quartiles are taken over all texts of documents that pass the base rules, equal ones once, in
steps of 1 / STEPS bits.

Defined results: null texts have no words and no bytes; they and all of fewer than MIN_WORDS words fail the base rules.
A null language is a language of its own.  Repeated rows are judged each, alike.  Words, windows and lines are compared
by 64-bit keys of their bytes, with case.  Lines end at line feeds only.  Empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes, _scratch

ORDER = 5
PAD = 10
#: Grams in an array that is sent out: 12 bytes each.
SLICE = 4 << 20
#: Grams that a task counts before it hands them on.
HELD = 4 << 20
#: Bytes of text scored at once, also within one long text.
BLOCK = 1 << 20
#: Steps of fixed-point logarithms in a bit.
ONE = 1 << 20

MIN_WORDS, REPEAT_WORDS, REPEAT_PERCENT = 10, 5, 20
SPREAD, MIN_DISTANCE, SHORT, STEPS = 2.0, 0.05, 3000, 1000
#: Languages whose bands are sent out; more are joined.
FEW_LANGUAGES = 10_000

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _padded(buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a group with a start before each text, which of them are of texts, and each text's first byte's place
    among those."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.full(len(buf) + n * (order - 1), PAD, np.uint8)
    starts = offsets[:-1] + (order - 1) * np.arange(1, n + 1)
    text = np.zeros(len(out), bool)
    at = np.arange(len(buf)) + np.repeat(starts - offsets[:-1], size)
    out[at], text[at] = buf, True
    return out, text, offsets


def _grams(buf: np.ndarray, order: int) -> np.ndarray:
    """The gram that ends at each byte from the order-th on."""
    n = len(buf) - order + 1
    out = buf[:n].astype(np.int64)
    for k in range(1, order):
        out <<= 8
        out |= buf[k : n + k]
    return out


def _blocks(column: pa.Array, order: int):
    """Grams of the texts of a column in blocks: (first row of the group, rows, bounds of the rows' grams, first gram of
    the block, grams)."""
    data, offsets = _bytes.buffers(column)
    for i, j in _bytes.groups(offsets):
        off = offsets[i : j + 1] - offsets[i]
        buf, text, bounds = _padded(data[offsets[i] : offsets[j]], off, order)
        done = 0
        for a in range(order - 1, max(len(buf), order), BLOCK):
            b = min(a + BLOCK, len(buf))
            g = _grams(buf[a - order + 1 : b], order)[text[a:b]]
            yield i, j - i, bounds, done, g
            done += len(g)


def gram_counts(documents: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """gram, n of all texts."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.argsort(keys, kind="stable")
            keys, n = keys[by], n[by]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first)

        rows = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["gram", "n"])
        for batch in batches:
            for *_, g in _blocks(batch.column(0), order):
                if not len(g):
                    continue
                g.sort()
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                held.append((g[first], np.diff(np.append(first, len(g)))))
                if len(held) > 1 and sum(len(k) for k, _ in held[1:]) > max(len(held[0][0]), 1 << 18):
                    held = [merged()]
                    if len(held[0][0]) > HELD:
                        yield rows()
                        held = []
        if held:
            held = [merged()]
            yield rows()

    _bytes.modest(documents.sparkSession)
    return documents.select(F.col(text_col).cast("string")).mapInArrow(_bytes.tidy(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _last(gram: Column, k: int) -> Column:
    """The last k bytes."""
    return gram.bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long"))


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the numbers of grams with counts 1 to 4; without
    them, or where they don't fall as counts of counts do, halves."""
    if min(n) <= 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    out = [i + 1 - (i + 2) * y * n[i + 1] / n[i] for i in range(3)]
    return [d if 0 < d < i + 1 else (i + 1) / 2 for i, d in enumerate(out)]


class Model:
    """Tables of a model: probabilities (k, gram, p) of the grams that were seen, and weights (k, context, weight) that
    contexts give to the next lower order."""

    def __init__(self, order: int, probabilities: DataFrame, weights: DataFrame):
        self.order, self.probabilities, self.weights = order, probabilities, weights

    def own(self) -> DataFrame:
        """gram, p of all grams of the training texts."""
        return self.probabilities.where(F.col("k") == self.order).select("gram", "p")

    def of(self, grams: DataFrame) -> DataFrame:
        """gram, p of any distinct grams (of ORDER bytes), seen or not."""
        sets = {self.order: grams.select("gram")}
        for k in range(self.order - 1, 0, -1):
            sets[k] = sets[k + 1].select(_last(F.col("gram"), k).alias("gram")).distinct()
        lower = None
        for k in range(1, self.order + 1):
            p = self.probabilities.where(F.col("k") == k).select("gram", F.col("p").alias("seen"))
            w = self.weights.where(F.col("k") == k).select("context", "weight")
            g = sets[k].join(p, "gram", "left").withColumn("context", F.shiftright("gram", 8)).join(w, "context", "left")
            if lower is None:
                g = g.withColumn("low", F.lit(1 / 256))
            else:
                g = g.withColumn("tail", _last(F.col("gram"), k - 1)).join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("low")), "tail")
            lower = g.select("gram", F.coalesce("seen", F.coalesce("weight", F.lit(1.0)) * F.col("low")).alias("p"))
        return lower


def train(documents: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """Counts the grams of all documents and stores the model."""
    spark = documents.sparkSession
    top, path = _scratch.save(gram_counts(documents, text_col, order), "grams", "snappy")
    table, every = top, top.select(F.lit(order).alias("k"), "gram", "n")
    for k in range(order - 1, 0, -1):
        table = table.groupBy(_last(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n"))
        every = every.unionByName(table.select(F.lit(k).alias("k"), "gram", "n"))
    counts, counts_path = _scratch.save(every, "gram-counts", "snappy", "k")
    _scratch.drop(spark, path)
    found = {r["k"]: [r[f"n{i}"] or 0 for i in range(1, 5)] for r in counts.groupBy("k").agg(*(F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in range(1, 5))).collect()}  # a row for each order
    lower, probabilities, weights, made = None, None, None, [counts_path]
    for k in range(1, order + 1):
        d = discounts(found.get(k, [0]))
        t = counts.where(F.col("k") == k).select("gram", "n", F.shiftright("gram", 8).alias("context"))
        kinds = [F.sum((F.col("n") == i).cast("long")) for i in (1, 2)] + [F.sum((F.col("n") >= 3).cast("long"))]
        w = t.groupBy("context").agg(F.sum("n").alias("total"), sum((x * y for x, y in zip(kinds, d, strict=True)), F.lit(0.0)).alias("w")).select("context", "total", (F.col("w") / F.col("total")).alias("weight"))
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        g = t.join(w, "context").withColumn("high", (F.col("n") - cut) / F.col("total"))
        if lower is None:
            p = g.select("gram", (F.col("high") + F.col("weight") / 256).alias("p"))
        else:
            g = g.withColumn("tail", _last(F.col("gram"), k - 1)).join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("low")), "tail")
            p = g.select("gram", (F.col("high") + F.col("weight") * F.col("low")).alias("p"))
        lower = p
        p, w = p.select(F.lit(k).alias("k"), "gram", "p"), w.select(F.lit(k).alias("k"), "context", "weight")
        probabilities, weights = (p, w) if probabilities is None else (probabilities.unionByName(p), weights.unionByName(w))
    out = Model(order, _scratch.save(probabilities, "gram-p", "snappy", "k")[0], _scratch.save(weights, "gram-w", "snappy", "k")[0])
    _scratch.drop(spark, *made)
    return out


def _repeats(buf: np.ndarray, st: np.ndarray, en: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each document that are in windows found twice or more in it."""
    n = len(first) - 1
    h, begin = _bytes.ngram_hashes(_bytes.word_hashes(buf, st, en, _bytes.SAME), first, REPEAT_WORDS)
    if not len(h):
        return np.zeros(n, np.int64)
    windows = np.diff(begin)
    doc = np.repeat(np.arange(n), windows)
    key = _bytes.mix(h ^ _bytes.mix(doc.astype(np.uint64)))
    by = np.argsort(key)
    same = key[by][1:] == key[by][:-1]
    twice = np.zeros(len(key), bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    at = (first[doc] + np.arange(len(key)) - begin[doc])[twice]
    change = np.zeros(len(st) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + REPEAT_WORDS, -1)
    return np.diff(np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])[first])


def _repeated_lines(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines of each document that have a word and equal an earlier line of it."""
    n = len(offsets) - 1
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    edge[1:][buf == PAD] = True  # a line starts after a line feed
    starts = np.flatnonzero(edge)
    st, en = starts[:-1], starts[1:].copy()
    if not len(st):
        return np.zeros(n, np.int64)
    en -= buf[en - 1] == PAD
    words = np.concatenate([[0], np.cumsum(_bytes.NONSPACE[buf])])
    has = words[en] > words[st]
    st, en = st[has], en[has]
    doc = np.searchsorted(offsets, st, side="right") - 1
    key = np.unique(np.stack([doc.astype(np.uint64), _bytes.word_hashes(buf, st, en, _bytes.SAME)], axis=1), axis=0) if len(st) else np.zeros((0, 2), np.uint64)
    return np.bincount(doc, minlength=n) - np.bincount(key[:, 0].astype(np.int64), minlength=n)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes"]


def _counts(column: pa.Array) -> np.ndarray:
    """COUNTS of each text."""
    out = np.zeros((len(column), len(COUNTS)), np.int64)
    _, offsets = _bytes.buffers(column)
    for i, j, buf, st, en, first in _bytes.documents(column, _bytes.NONSPACE):
        off = offsets[i : j + 1] - offsets[i]
        point = np.concatenate([[0], np.cumsum(_bytes.NONSPACE[buf] & ((buf & 0xC0) != 0x80))])
        symbol = np.concatenate([[0], np.cumsum(_SYMBOLS[buf])])
        out[i:j] = np.stack([np.diff(first), np.diff(point[off]), np.diff(symbol[off]), _repeated_lines(buf, off), _repeats(buf, st, en, first), np.diff(off)], axis=1)
    return out


def _rated(documents: DataFrame, columns: list[str], text_col: str, keys: np.ndarray, logs: np.ndarray, order: int, counts: bool) -> DataFrame:
    """The columns, COUNTS if asked for, and `log2p`: the sum over those grams of each text that keys holds."""
    sent = documents.sparkSession.sparkContext.broadcast((keys, logs))
    kept = documents.select(*columns, F.col(text_col).alias("_text"))

    def run(batches):
        k, v = sent.value
        for batch in batches:
            text = batch.column(len(columns))
            total = np.zeros(len(batch), np.int64)
            for i, n, bounds, done, g in _blocks(text, order):
                if len(g) and len(k):
                    at = np.minimum(np.searchsorted(k, g), len(k) - 1)
                    sums = np.concatenate([[0], np.cumsum(np.where(k[at] == g, v[at], 0).astype(np.int64))])
                    total[i : i + n] += np.diff(sums[np.clip(bounds - done, 0, len(g))])
            more = [pa.array(x) for x in _counts(text).T] if counts else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more, pa.array(total)], names=[*columns, *(COUNTS if counts else []), "log2p"])

    ddl = kept.select(*columns, *(F.lit(0).cast("long").alias(c) for c in [*(COUNTS if counts else []), "log2p"])).schema
    return kept.mapInArrow(_bytes.tidy(run), ddl)


def scored(documents: DataFrame, lookup: DataFrame, columns: list[str], text_col: str = "text", order: int = ORDER) -> DataFrame:
    """The columns, COUNTS and log2p (in units of 1 / ONE) of every document.  lookup: gram, p of all their grams."""
    _bytes.modest(documents.sparkSession)
    logs = lookup.select("gram", F.round(F.log2("p") * ONE).cast("int").alias("v"))
    n = logs.count()
    slices = max(1, -(-n // SLICE))

    def arrays(part: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = part.sort("gram").toArrow()  # SLICE rows, or as many as a hash gives to a slice
        return got["gram"].to_numpy(), got["v"].to_numpy().astype(np.int32)

    if slices == 1:
        return _rated(documents, columns, text_col, *arrays(logs), order, True)
    key = ["_k1", "_k2"]
    docs = documents.select(*columns, text_col, F.xxhash64(text_col).alias("_k1"), F.xxhash64(text_col, F.lit(1)).alias("_k2"))
    parts = None
    for s in range(2 * slices):  # of half a slice each, as a hash deals them
        a = arrays(logs.where(F.pmod(F.xxhash64("gram"), F.lit(2 * slices)) == s))
        if s == 0:
            first = _scratch.saved(_rated(docs, [*columns, *key], text_col, *a, order, True), "rated")
        else:
            parts = _scratch.append(_rated(docs, key, text_col, *a, order, False).groupBy(*key).agg(F.max("log2p").alias("part")), "rated-part", parts)
    more = docs.sparkSession.read.parquet(parts).groupBy(*key).agg(F.sum("part").alias("part"))
    return first.join(more, key, "left").withColumn("log2p", F.col("log2p") + F.coalesce("part", F.lit(0))).drop("part", *key)


def bands(rated: DataFrame, lang_col: str = "lang") -> DataFrame:
    """lang, q1, q3: quartiles of bits of the distinct texts of each language.  rated: lang, bits and the counts."""
    texts = rated.where("bits IS NOT NULL").select(lang_col, "log2p", "n_bytes", "word_chars", F.floor(F.col("bits") * STEPS).alias("bin")).distinct()
    bins = texts.groupBy(lang_col, "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(lang_col)  # a row for each step that occurs
    up = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    q = lambda share: F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("bin"))) / STEPS
    return up.groupBy(lang_col).agg(q(0.25).alias("q1"), q(0.75).alias("q3"))


def judged(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", spread: float = SPREAD, min_distance: float = MIN_DISTANCE) -> DataFrame:
    """doc_id, the counts, base_failed, kept, lang, bits, perplexity and the band (low, high, in bits) of every document,
    by a model of all of them."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    out = scored(docs, train(docs).own(), ["doc_id", "lang"])
    bits = F.when(F.col("n_bytes") > 0, -F.col("log2p") / ONE / F.col("n_bytes"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = _scratch.saved(out.withColumn("bits", bits).withColumn("base_failed", failed), "rated")
    b = bands(out.where("NOT base_failed")).withColumnRenamed("lang", "_lang")
    few = b.limit(FEW_LANGUAGES + 1).count() <= FEW_LANGUAGES
    out = out.join(F.broadcast(b) if few else b, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    reach = F.greatest(F.col("q3") - F.col("q1"), F.lit(min_distance)) * spread * F.sqrt(1 + SHORT / F.greatest(F.col("n_bytes"), F.lit(1)))
    out = out.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach, "perplexity": F.pow(F.lit(2.0), "bits")})
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False))
    return out.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & inside).alias("kept"), "lang", "bits", "perplexity", "low", "high")


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents; the model and the bands are of all of them."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
