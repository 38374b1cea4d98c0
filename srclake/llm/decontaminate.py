"""Benchmark decontamination over a positional inverted index.

`build_index` stores the postings of every word of every document: one row per segment (a few thousand documents' words
at most a few MB), with the segment's distinct word keys in order and, for each, the word's positions.  A position
counts the segment's words from 0; documents are ranges of positions, so a list of positions is a posting list of
(document, offset).  `phrases` answers exact phrases by intersecting, for each, the offset-adjusted lists of its words,
from the one that is rarest in the segment; `near` finds sets of words within a span.  Words are compared by 64-bit
keys of their lower-cased bytes.

Queries are sent out in blocks of BLOCK_WORDS words, so what is broadcast is bounded; segments pass through a worker
once for each block, which suits a benchmark of few blocks.  Benchmark rows come to the driver a partition at a time.

Defined results: null texts and texts without words have no postings and one row with zeros; items without words find
nothing.  Repeated document rows are rows of their own; a repeated item_id counts once for a document.
The windows of an item without id are hit like all others, but it is in no list of items.  Empty tables
give no rows, or rows without hits.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes, _scratch

WINDOW = 13
#: Words of benchmark items that are sent to the executors at once: each has WINDOW keys of 8 bytes, so 27 MB.
BLOCK_WORDS = 1 << 18
INDEX = "docs binary, null_id binary, first binary, terms binary, starts binary, positions binary"


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index segments of whole documents; lists of integers are little-endian binaries."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for i, j, buf, st, en, first in _bytes.documents(batch.column(1), _bytes.ALNUM):
                h = _bytes.word_hashes(buf, st, en)
                order = np.argsort(h, kind="stable").astype(np.uint32)
                s = h[order]
                new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
                row = [ids[i:j], null[i:j].astype(np.uint8), first.astype(np.uint32), s[new], np.append(new, len(s)).astype(np.uint32), order]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=["docs", "null_id", "first", "terms", "starts", "positions"])

    return documents.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_bytes.tidy(run), INDEX)


class Segment:
    """One row of the index."""

    def __init__(self, docs: bytes, null_id: bytes, first: bytes, terms: bytes, starts: bytes, positions: bytes):
        self.docs, self.null = np.frombuffer(docs, np.int64), np.frombuffer(null_id, np.uint8).astype(bool)
        self.first, self.terms = np.frombuffer(first, np.uint32).astype(np.int64), np.frombuffer(terms, np.uint64)
        self.starts, self.positions = np.frombuffer(starts, np.uint32).astype(np.int64), np.frombuffer(positions, np.uint32).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each key's posting list (-1: none), and its length."""
        if not len(self.terms):
            return np.full(keys.shape, -1), np.zeros(keys.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, keys), len(self.terms) - 1)
        at = np.where(self.terms[at] == keys, at, -1)
        return at, np.where(at >= 0, self.starts[at + 1] - self.starts[at], 0)

    def phrases(self, keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences (phrase number, first position) of phrases: rows of word keys, of which `sizes` count."""
        at, n = self.find(keys)
        inside = np.arange(keys.shape[1])[None, :] < sizes[:, None]
        live = np.flatnonzero(~((at < 0) & inside).any(axis=1) & (sizes > 0))
        if not len(live):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, sizes = at[live], sizes[live]
        by_rarity = np.argsort(np.where(inside[live], n[live], np.iinfo(np.int64).max), axis=1, kind="stable")
        # the rarest word's list, less its offset in the phrase
        k0 = by_rarity[:, 0]
        lists = at[np.arange(len(at)), k0]
        count = self.starts[lists + 1] - self.starts[lists]
        who = np.repeat(np.arange(len(at)), count)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        start = self.positions[self.starts[lists][who] + nth] - k0[who]
        ok = (start >= 0) & (start + sizes[who] <= self.first[-1])
        who, start = who[ok], start[ok]
        doc = np.searchsorted(self.first, start, side="right") - 1
        ok = start + sizes[who] <= self.first[doc + 1]
        who, start = who[ok], start[ok]
        # key of a posting: (list, position); lists are stored in that order
        width = np.int64(self.first[-1] + 1)
        if not hasattr(self, "_postings"):
            self._postings = np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) * width + self.positions
        for r in range(1, keys.shape[1]):
            if not len(who):
                break
            k = by_rarity[who, r]
            want = at[who, k] * width + start + k
            got = np.minimum(np.searchsorted(self._postings, want), len(self._postings) - 1)
            ok = (self._postings[got] == want) | (r >= sizes[who])
            who, start = who[ok], start[ok]
        return live[who], start

    def near(self, keys: np.ndarray, span: int) -> list[tuple[int, int, int]]:
        """(document number, first and last position in it) of the shortest stretches of at most `span` words that hold
        all the words; stretches that hold a shorter one are left out."""
        at, _ = self.find(np.unique(keys))
        if not len(at) or (at < 0).any():
            return []
        pos = np.concatenate([self.positions[self.starts[a] : self.starts[a + 1]] for a in at])
        which = np.concatenate([np.full(self.starts[a + 1] - self.starts[a], i) for i, a in enumerate(at)])
        order = np.argsort(pos)
        pos, which = pos[order], which[order]
        last, out = np.full(len(at), -1), []
        for p, w in zip(pos.tolist(), which.tolist(), strict=True):
            last[w] = p
            low = int(last.min())
            d = int(np.searchsorted(self.first, p, side="right")) - 1
            if low >= self.first[d] and p - low < span:
                found = (d, low - int(self.first[d]), p - int(self.first[d]))
                if out and out[-1][0] == d and out[-1][1] == found[1]:
                    continue  # it holds the one before
                out.append(found)
        return out


def windows(items: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text"):
    """Blocks of the items' n-word windows: (item ids, item number of each window, window keys, window sizes)."""
    import itertools

    rows = items.select(F.col(id_col).cast("string").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def block(held):
        ids, item, keys, sizes = [], [], [], []
        for ident, text in held:
            for *_, buf, st, en, _f in _bytes.documents(pa.array([text], pa.string()), _bytes.ALNUM):
                h = _bytes.word_hashes(buf, st, en)
                if not len(h):
                    continue
                m = min(n, len(h))
                w = np.lib.stride_tricks.sliding_window_view(h, m)
                keys.append(np.pad(w, ((0, 0), (0, n - m))))
                sizes.append(np.full(len(w), m))
                item.append(np.full(len(w), len(ids)))
            ids.append(ident)
        if not keys:
            return None
        return ids, np.concatenate(item), np.concatenate(keys), np.concatenate(sizes)

    held, words = [], 0
    for r in itertools.chain(rows.toLocalIterator(), [None]):  # a partition at a time
        if r is None or (held and words + len(r["text"]) // 2 > BLOCK_WORDS):
            if held and (b := block(held)):
                yield b
            held, words = [], 0
        if r is not None:
            held.append((r["id"], r["text"]))
            words += len(r["text"]) // 2 + 1


HITS = "docs binary, null_id binary, first binary, terms binary, starts binary, positions binary, hit binary, hit_items array<string>, hit_docs binary"


def search(index: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (ids of items with an occurring window, sorted)."""
    spark = index.sparkSession
    found = index.select("*", F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("hit_items"), F.lit(None).cast("binary").alias("hit_docs"))
    for b in windows(items, n, id_col, text_col):
        found = found.mapInArrow(_search_block(spark.sparkContext.broadcast(b)), HITS)

    def finish(batches):
        for batch in batches:
            for r in batch.to_pylist():
                seg = Segment(*(r[c] for c in ("docs", "null_id", "first", "terms", "starts", "positions")))
                hit = np.frombuffer(r["hit"], np.uint8) if r["hit"] is not None else np.zeros(int(seg.first[-1]), np.uint8)
                run = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
                lists: dict[int, set] = {}
                for d, x in zip(np.frombuffer(r["hit_docs"] or b"", np.uint32).tolist(), r["hit_items"] or [], strict=True):
                    if x is not None:
                        lists.setdefault(d, set()).add(x)
                yield pa.RecordBatch.from_arrays([pa.array(seg.docs, pa.int64(), mask=seg.null), pa.array(np.diff(seg.first)), pa.array(run[seg.first[1:]] - run[seg.first[:-1]]), pa.array([sorted(lists.get(d, ())) for d in range(len(seg.docs))], pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "items"])

    return found.mapInArrow(_bytes.tidy(finish), "doc_id long, n_words long, n_hit long, items array<string>")


def _search_block(sent):
    def run(batches):
        ids, item, keys, sizes = sent.value
        for batch in batches:
            for r in batch.to_pylist():
                seg = Segment(*(r[c] for c in ("docs", "null_id", "first", "terms", "starts", "positions")))
                who, start = seg.phrases(keys, sizes)
                if len(who):
                    hit = np.frombuffer(r["hit"], np.uint8).copy() if r["hit"] is not None else np.zeros(int(seg.first[-1]), np.uint8)
                    marks = np.zeros(len(hit) + 1, np.int64)
                    np.add.at(marks, start, 1)
                    np.add.at(marks, start + sizes[who], -1)
                    hit |= (np.cumsum(marks[:-1]) > 0).astype(np.uint8)
                    doc = np.searchsorted(seg.first, start, side="right") - 1
                    pairs = np.unique(np.stack([doc, item[who]]), axis=1)
                    r["hit"] = hit.tobytes()
                    r["hit_items"] = (r["hit_items"] or []) + [ids[x] for x in pairs[1]]  # None: an item without id
                    r["hit_docs"] = (r["hit_docs"] or b"") + pairs[0].astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_pylist([r], schema=batch.schema)

    return run


def near(index: DataFrame, words: list[str], span: int) -> DataFrame:
    """Proximity matches: doc_id, first and last word of the shortest stretches of at most `span` words with all words."""
    text = pa.array([" ".join(words)], pa.string())
    keys = np.concatenate([_bytes.word_hashes(buf, st, en) for *_, buf, st, en, _ in _bytes.documents(text, _bytes.ALNUM)])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                seg = Segment(*(r[c] for c in ("docs", "null_id", "first", "terms", "starts", "positions")))
                hits = seg.near(keys, span)
                yield pa.RecordBatch.from_arrays([pa.array([None if seg.null[d] else int(seg.docs[d]) for d, _, _ in hits], pa.int64()), pa.array([a for _, a, _ in hits], pa.int64()), pa.array([b for *_, b in hits], pa.int64())], names=["doc_id", "first_word", "last_word"])

    return index.mapInArrow(_bytes.tidy(run), "doc_id long, first_word long, last_word long")


def contaminated(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """search() over a stored index of all documents, with the verdict: at least 5 % of the words are hit."""
    _bytes.modest(documents.sparkSession)
    index = _scratch.saved(build_index(documents), "postings")
    return search(index, benchmark, n).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, list_slice(ws, i, i + least(13, len(ws)) - 1) AS win, least(13, len(ws)) AS m
  FROM b, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) u(i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT m FROM iw),
dw AS (
  SELECT doc_id, i, m, list_slice(ws, i, i + m - 1) AS win
  FROM w, sizes, unnest(range(1, greatest(len(ws) - m + 2, 1))) u(i)
), hits AS (SELECT dw.doc_id, dw.i, dw.m, iw.item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + m)) v(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS its FROM hits GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(its, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
