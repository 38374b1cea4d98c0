"""Packing of token sequences: shortest-pack-first over the length histogram.

Documents are tokenized; one longer than the sequence is cut into whole sequences and a rest.  The histogram of piece
lengths (as many bins as a sequence has tokens) goes to the driver, where lengths are placed longest first, each time
into the pack that is shortest so far, if the piece still fits there; many equal packs are one pattern with a count.
Pieces are cut at whole sequences only, so gaps stay as padding.  Patterns are joined back to pieces by each piece's
rank among those of its length: ranks come from counts by (partition, length), summed up over partitions, so no group of
equal lengths is gathered.

Defined results: null and empty texts are the end token alone.  Repeated rows are pieces of their own.  Empty tables
give no rows.  Other columns are kept by `pack`, ignored by `tokenize`.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes, _scratch

SEQUENCE = 4096
END = 2
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers; more are forgotten all at once.
CACHE_WORDS = 400_000
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[32, 9, 10, 11, 12, 13]] = True

_cache: dict[str, list[dict[str, bytes]]] = {}

#: Normalizers and splitting pattern of the tokenizers whose ids can be had word by word.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A run of ASCII marks (no apostrophe) from a letter or digit to white space: the pattern splits there anyway.
_MARKS = re.compile(r"([!-&(-/:-@\[-^`{-~])(?<=[^\W_].)([!-&(-/:-@\[-^`{-~]*)(?=\s|\Z)")
#: Words that are one piece of the pattern and that the normalizers leave alone.
_PLAIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u017e]+|[!-&(-/:-@\[-^`{-~]+")
#: Letters beyond Latin, combining marks and control strings: such texts are tokenized whole.
_FAR = re.compile("[\u0130\u0149\u0300-\U0010ffff]|<\\|")


@functools.cache
def _tokenizer(path: str):
    """The tokenizer; byte-level letters of code points if it splits by the known pattern, else None."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    spec = json.loads(t.to_str())
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    splits = [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
    if steps != _NORMALIZERS or splits != [_SPLIT, None] or spec["model"]["type"] != "BPE":
        return t, None
    # byte-level alphabet: printable bytes are themselves, the others follow from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return t, {c: "".join(letter[b] for b in chr(c).encode()) for c in range(33, 0x180)}


def _learn(words, recent: dict[str, bytes], older: dict[str, bytes], path: str) -> None:
    """Puts each word's ids in recent, from older where it is there."""
    t, letters = _tokenizer(path)
    plain, pieces, encode = _PLAIN.fullmatch, t.model.tokenize, t.encode
    for w in words:
        if w in older:
            recent[w] = older[w]
        elif plain(w):
            recent[w] = array("I", [x.id for x in pieces(w if w.isascii() else w.translate(letters))]).tobytes()
        else:
            recent[w] = array("I", encode(w, add_special_tokens=False).ids).tobytes()


def _is_far(text: str) -> bool:
    try:
        text.encode("latin-1")
        return "<|" in text
    except UnicodeEncodeError:
        return bool(_FAR.search(text))


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text, as the tokenizer gives them without special tokens.

    A tokenizer of the known kind drops white space and never joins across it, so ids of a text are those of its words
    between spaces.  Words seen lately are looked up; when half the cache is full, the older half goes."""
    t, letters = _tokenizer(path)
    far = [i for i, x in enumerate(texts) if letters is None or _is_far(x)]
    whole = dict(zip(far, (np.array(e.ids, "<u4") for e in t.encode_batch([texts[i] for i in far], add_special_tokens=False)), strict=True))
    known = _cache.setdefault(path, [{}, {}])
    words = [[] if i in whole else _MARKS.sub(r" \1\2", x.lower()).split(" ") for i, x in enumerate(texts)]
    new = {w for ws in words for w in ws}.difference(known[0])
    if len(known[0]) + len(new) > CACHE_WORDS // 2 and known[0]:
        known[:] = [{}, known[0]]
        new = {w for ws in words for w in ws}
    recent, older = known
    _learn(new, recent, older, path)
    get = recent.__getitem__
    return [whole[i] if i in whole else np.frombuffer(b"".join(map(get, ws)), "<u4") for i, ws in enumerate(words)]


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, part long, nth long"


def tokenize(documents: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `sequence` ids (little-endian unsigned 32-bit), with each piece's number among those of its
    length in its partition."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            _, offsets = _bytes.buffers(batch.column(1))
            for i, j in _bytes.groups(offsets):
                rows = []
                docs = batch.column(0).slice(i, j - i).to_pylist()
                texts = batch.column(1).slice(i, j - i).fill_null("").to_pylist()
                for doc, ids in zip(docs, token_ids(texts, tokenizer), strict=True):
                    ids = np.append(ids, np.uint32(end))
                    for at in range(0, len(ids), sequence):
                        piece = ids[at : at + sequence]
                        rows.append((doc, at, len(piece), piece.astype("<u4").tobytes(), len(ids), part, seen[len(piece)]))
                        seen[len(piece)] += 1
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "part", "nth"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(_bytes.tidy(run), PIECES)


def shortest_pack_first(histogram: dict[int, int], sequence: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths) that hold every piece of the histogram {length: count} once."""
    open_by_size: dict[int, list[list]] = defaultdict(list)  # used tokens -> [count, lengths] patterns
    sizes: list[int] = []  # sorted used sizes with patterns
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(count: int, lengths: tuple[int, ...], used: int) -> None:
        if used == sequence:
            done.append((count, lengths))
            return
        if not open_by_size[used]:
            bisect.insort(sizes, used)
        open_by_size[used].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not sizes or sizes[0] + length > sequence:
                # no pack is short enough: new packs
                put(left, (length,), length)
                break
            used = sizes[0]
            pattern = open_by_size[used][-1]
            n = min(left, pattern[0])
            pattern[0] -= n
            if not pattern[0]:
                open_by_size[used].pop()
                if not open_by_size[used]:
                    sizes.pop(0)
            put(n, (*pattern[1], length), used + length)
            left -= n
    return done + [(c, ls) for s in sizes for c, ls in open_by_size[s]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Ranges of ranks: pieces of `length` with rank from `low` on go to sequences `base` + (rank - low) at `offset`.

    Sorted by (length, low)."""
    out, next_rank, base = [], defaultdict(int), 0
    for count, lengths in patterns:
        at = 0
        for length in lengths:
            out.append((length, next_rank[length], base, at))
            next_rank[length] += count
            at += length
        base += count
    table = np.array(sorted(out), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "low": table[:, 1], "base": table[:, 2], "offset": table[:, 3]}


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (length, part, nth and any other columns)."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    counts = _scratch.saved(counts, "counts")
    total = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `sequence` rows
    table = slots(shortest_pack_first({r["length"]: r["n"] for r in total}, sequence))
    # the first rank of each partition's pieces of a length: one row for each partition in a window
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))
    ranked = pieces.join(first.hint("merge"), ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth")).drop("first", "part", "nth")
    sent = spark.sparkContext.broadcast(table)
    at = {c: ranked.columns.index(c) for c in ("length", "rank")}

    def run(batches):
        t = sent.value
        # one sorted key of (length, low): ranks are below 2^48
        key = (t["length"] << 48) + t["low"]
        for batch in batches:
            length, rank = batch.column(at["length"]).to_numpy(), batch.column(at["rank"]).to_numpy()
            k = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t["base"][k] + rank - t["low"][k]), pa.array(t["offset"][k])], names=[*batch.schema.names, "sequence_id", "offset"])

    schema = ranked.selectExpr("*", "CAST(0 AS long) AS sequence_id", "CAST(0 AS long) AS offset").schema
    return ranked.mapInArrow(_bytes.tidy(run), schema).drop("rank")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digests of all pieces with their places."""
    _bytes.modest(documents.sparkSession)
    pieces = tokenize(documents, tokenizer or tokenizer_path())
    pieces = _scratch.saved(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces", "snappy")
    return pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
