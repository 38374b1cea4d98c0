"""Language identification of mixed-language texts.

Words are runs of letters of one script.  A script's range narrows a word's candidates to the languages whose training
words use it.  A word's score for a candidate is the log-likelihood of its letter trigrams (with word ends); Viterbi over
the words, with a penalty for each switch, labels spans of one language.  A document's language is the one with most
letters; its score is that share of the scored letters times the language's posterior over those spans.

Trigram counts are summed over all training documents: a table of at most BUCKETS rows a language.

Words of a script that no language uses take part only in texts that have no others: there every language is a candidate,
and the score is that of the trigrams' posterior times FOREIGN.

Defined results: a text that is null, empty or without letters is "und" with score 0, as is every text if nothing was
learned.  Bytes that are no UTF-8 are read as U+FFFD, no letter.  Ties go to the language first in order of name.  Repeated rows are rows of their own and count each in training; empty tables give no rows.  Whole
texts are read, however long; other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes

BUCKETS = 1 << 16
#: Log-likelihood lost by each switch of language.
SWITCH = 12.0
#: A language uses a script if this share of its training letters is of it.
SCRIPT_SHARE = 0.01
#: Score of a text in scripts of no learned language, as a share of what it would be otherwise.
FOREIGN = 0.1
GROUP_BYTES = 1 << 20
UND = "und"
#: First code points of script ranges; letters from one entry to the next are of one script.
SCRIPT_STARTS = [0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xB80, 0xC00, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x13A0, 0x1780, 0x1E00, 0x1F00, 0x2000, 0x2E80, 0x3040, 0x3100, 0xAC00, 0xD800, 0xF900, 0xFB1D, 0xFB50, 0xFF00, 0xFF66, 0x20000]
#: The same script in another range.
_SAME = {0x1E00: 0x0, 0x2000: 0x0, 0xFF00: 0x0, 0x1F00: 0x370, 0xFB1D: 0x590, 0xFB50: 0x600, 0xAC00: 0x1100, 0xF900: 0x2E80, 0x20000: 0x2E80, 0xFF66: 0x3040}


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point up to the end of the last Han block: script number, 0 if not a letter; lower case."""
    starts = sorted(SCRIPT_STARTS)
    names = sorted({_SAME.get(s, s) for s in starts})
    number = {s: names.index(_SAME.get(s, s)) + 1 for s in starts}
    n = 0x33480
    where = np.searchsorted(np.array(starts), np.arange(n), side="right") - 1
    script = np.array([number[s] for s in starts], np.uint8)[where]
    lower = np.arange(n, dtype=np.uint32)
    for cp in range(n):
        c = chr(cp)
        if not unicodedata.category(c).startswith(("L", "M")):
            script[cp] = 0
        elif len(low := c.lower()) == 1:
            lower[cp] = ord(low)
    script[-1] = 0  # all code points beyond are no letters
    return script, lower


def letters(column: pa.Array):
    """For each group of rows: first row, number of rows, document of each word, its length, script, and the trigram
    buckets and word number of each letter."""
    script_of, lower_of = _tables()
    data, offsets = _bytes.buffers(column)
    for i, j in _bytes.groups(offsets, GROUP_BYTES):
        text = data[offsets[i] : offsets[j]]
        lead = (text & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(lead)])[offsets[i : j + 1] - offsets[i]]  # code points before each document
        cp = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        cp = np.minimum(cp, len(script_of) - 1)
        script, low = script_of[cp], lower_of[cp]
        n = len(cp)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        same = np.zeros(n + 1, bool)  # this letter continues the word of the one before
        same[1:n] = (script[1:] == script[:-1]) & (script[1:] > 0) & ~edge[1:n]
        is_letter = script > 0
        prev = np.where(same[:n], np.concatenate([[0], low[:-1]]), 0).astype(np.uint32)
        following = np.where(same[1:], np.concatenate([low[1:], [0]]), 0).astype(np.uint32)
        key = (prev * np.uint32(0x9E3779B1) + low * np.uint32(0x85EBCA77) + following * np.uint32(0xC2B2AE3D)) ^ (low << np.uint32(9))
        bucket = ((key * np.uint32(0x27D4EB2F)) >> np.uint32(16))[is_letter]
        starts = np.flatnonzero(is_letter & ~same[:n])
        word = np.cumsum(is_letter & ~same[:n])[is_letter] - 1
        doc = np.searchsorted(at, starts, side="right") - 1
        yield i, j - i, doc, np.bincount(word, minlength=len(starts)), script[starts], bucket, word


def remainder(id_col: str | Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null ids give null."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")) if isinstance(id_col, str) else F.crc32(id_col.cast("string").cast("binary")), F.lit(of))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Model: langs, log-likelihood table (buckets x langs), and which scripts each language uses."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs], np.int64)
            for i, n, doc, length, script, bucket, word in letters(batch.column(0)):
                of = number[i : i + n][doc]
                got = np.bincount(of[word] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                used = np.bincount(of * 256 + script, weights=length, minlength=len(names) * 256).reshape(len(names), 256)
                for k, name in enumerate(names):
                    counts[name] = counts.get(name, 0) + got[k]
                    scripts[name] = scripts.get(name, 0) + used[k].astype(np.int64)
        for name, c in counts.items():
            both = np.concatenate([c, scripts[name]])
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(both[at].astype(np.int64))], names=["lang", "bucket", "n"])

    _bytes.modest(labelled.sparkSession)
    sums = labelled.select(F.col(text_col), F.col(lang_col)).mapInArrow(_bytes.tidy(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()  # at most BUCKETS + 256 a language
    langs = sorted(set(rows["lang"].to_pylist()))
    if not langs:
        return {"langs": [], "table": np.zeros((BUCKETS, 0), np.float32), "scripts": np.zeros((256, 0), bool)}
    k = np.array([langs.index(x) for x in rows["lang"].to_pylist()])
    full = np.zeros((len(langs), BUCKETS + 256))
    full[k, rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    tri, used = full[:, :BUCKETS] + 0.1, full[:, BUCKETS:]
    return {"langs": langs, "table": np.log(tri / tri.sum(axis=1, keepdims=True)).T.astype(np.float32).copy(), "scripts": (used >= SCRIPT_SHARE * np.maximum(used.sum(axis=1, keepdims=True), 1)).T & (used.T > 0)}


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of one document's words; s: scores, words x languages."""
    n, k = s.shape
    back = np.zeros((n, k), np.int32)
    best = s[0].astype(np.float64).copy()
    stay = np.arange(k)
    for t in range(1, n):
        top = int(best.argmax())
        move = best[top] - penalty > best
        back[t] = np.where(move, top, stay)
        best = np.where(move, best[top] - penalty, best) + s[t]
    out = np.empty(n, np.int32)
    out[-1] = int(best.argmax())
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def label_words(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of all words of several documents; first: each one's first word (one more entry at the end).

    A document's best single language is the whole best path if no stretch of words gains more than one penalty from
    any other languages; that is tested for all documents at once, and only the rest go through the recursion."""
    out = np.zeros(len(scores), np.int32)
    have = np.flatnonzero(np.diff(first) > 0)
    if not len(have) or scores.shape[1] == 1:
        return out
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.add.reduceat(scores.astype(np.float64), first[have], axis=0)
    best = np.zeros(len(first) - 1, np.int64)
    best[have] = total.argmax(axis=1)
    out[:] = best[doc]
    own = scores[np.arange(len(scores)), out]
    other = scores.copy()
    other[np.arange(len(scores)), out] = -np.inf
    gain = (other.max(axis=1) - own).astype(np.float64)
    # largest sum of a stretch: running sum less its smallest value before, with a drop between documents that no sum crosses
    run = np.cumsum(gain)
    before = np.concatenate([[0.0], run[:-1]])
    drop = 2 * (np.abs(gain).sum() + 1)
    low = np.minimum.accumulate(before - doc * drop) + doc * drop
    most = np.maximum.reduceat(run - low, first[have])
    for d in have[most > penalty]:
        out[first[d] : first[d + 1]] = viterbi(scores[first[d] : first[d + 1]], penalty)
    return out


def predict(documents: DataFrame, model: dict, text_col: str = "text", switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """Adds lang_pred and score to every row; with spans also the labelled spans (language, first word, words).

    They replace columns of these names."""
    documents = documents.drop("lang_pred", "score", *(["spans"] if spans else []))
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def run(batches):
        m = sent.value
        langs = m["langs"]
        for batch in batches:
            preds, scores, found = [UND] * len(batch), np.zeros(len(batch)), [[] for _ in range(len(batch))]
            for i, n, doc, length, script, bucket, word in letters(batch.column(at)) if langs else ():
                allowed = m["scripts"][script]
                known = allowed.any(axis=1)
                have = np.bincount(doc[known], minlength=n) > 0
                take = known | ~have[doc]  # texts without a word of a known script: all their words, for all languages
                allowed = np.where(known[:, None], allowed, True)
                per = np.add.reduceat(m["table"][bucket], np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64), axis=0) if len(length) else np.zeros((0, len(langs)), np.float32)
                s = np.where(allowed, per, per.min(axis=1, keepdims=True) - 20 if len(per) else 0)[take]
                doc, length = doc[take], length[take]
                first = np.searchsorted(doc, np.arange(n + 1), side="left")
                labels = label_words(s, first, switch)
                k = len(langs)
                by = np.bincount(doc * k + labels, weights=length, minlength=n * k).reshape(n, k)
                win = by.argmax(axis=1)
                sums = np.zeros((n, k))
                inside = labels == win[doc]
                for c in range(k):
                    sums[:, c] = np.bincount(doc[inside], weights=s[inside, c], minlength=n)
                post = np.exp(sums - sums.max(axis=1, keepdims=True))
                post = post[np.arange(n), win] / post.sum(axis=1)
                total = by.sum(axis=1)
                share = by[np.arange(n), win] / np.maximum(total, 1)
                for d in np.flatnonzero(total > 0):
                    preds[i + d] = langs[win[d]]
                scores[i : i + n] = np.where(total > 0, share * post, 0) * np.where(have, 1.0, FOREIGN)
                if spans and len(doc):
                    new = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])]))
                    for a, b in zip(new, [*new[1:], len(doc)], strict=True):
                        found[i + doc[a]].append({"lang": langs[labels[a]], "first_word": int(a - first[doc[a]]), "n_words": int(b - a)})
            cols = [*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            if spans:
                cols.append(pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "lang_pred", "score", *(["spans"] if spans else [])])

    ddl = documents.limit(0).selectExpr("*", *(["CAST(NULL AS string) AS lang_pred", "CAST(0 AS double) AS score"] + (["CAST(NULL AS array<struct<lang:string,first_word:int,n_words:int>>) AS spans"] if spans else []))).schema
    return documents.mapInArrow(_bytes.tidy(run), ddl)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Learns from documents of remainder 1 to 4 modulo 5, predicts all."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(d.where((remainder("doc_id", 5) != 0) & F.col("lang").isNotNull()))
    out = predict(d.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
