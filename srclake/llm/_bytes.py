"""Words of whole Arrow batches, found and hashed with numpy on the UTF-8 bytes.

A text column is one byte buffer plus offsets; masks over that buffer give every word's start and end, and one running
polynomial hash gives every word's 64-bit key, so no Python object is made per word.  Nothing is cut: a batch is dealt
into groups of whole documents of a few MB, and a longer document is a group of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: A-Z to a-z; every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Every byte as it is.
SAME = np.arange(256, dtype=np.uint8)
#: Bytes of words: digits, ASCII letters, all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words: all but space and the controls 9 to 13.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[32] = NONSPACE[9:14] = False

_powers: dict[str, np.ndarray] = {}


#: Rows of an Arrow batch: some MB of texts.
BATCH_ROWS = 1000


def modest(spark) -> None:
    """Batches of few rows, unless the session has a number of its own: whole batches are held on both sides of a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def tidy(run):
    """run, which afterwards gives the memory of its batches back to the system: Python workers live on for other tasks,
    and an executor has several."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, GROUP_BYTES + 1), base, dtype=np.uint64)
        p[0] = 1
        _powers[name] = np.multiply.accumulate(p)
        if len(p) > 8 * GROUP_BYTES:  # one very long document; don't keep its table
            return _powers.pop(name)
    return _powers[name]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit keys whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def groups(offsets: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_bounds(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in buf, and for each document the index of its first word (one more entry at the end).

    offsets count from 0 and cover buf; a word never spans two documents."""
    inside = is_word[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, by: np.ndarray = LOWER) -> np.ndarray:
    """64-bit key of each word's bytes after A-Z is lowered (or what else the table `by` says)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    run = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((by[buf].astype(np.uint64) + np.uint64(1)) * _power("p", _P, len(buf) + 1)[: len(buf)], out=run[1:])
    h = (run[ends] - run[starts]) * _power("inv", _P_INV, len(buf) + 1)[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def documents(column: pa.Array, is_word: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of rows: first row, row after the last, its bytes, word starts, word ends, first word of each row."""
    data, offsets = buffers(column)
    for i, j in groups(offsets, most):
        buf = data[offsets[i] : offsets[j]]
        yield i, j, buf, *word_bounds(buf, offsets[i : j + 1] - offsets[i], is_word)


def ngram_hashes(h: np.ndarray, first_word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-word windows of each document, in order, and the index of each document's first one (one more
    entry at the end).  A document of fewer words, but not none, has its whole sequence as the only window."""
    counts = np.diff(first_word)
    wins = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(wins)])
    total = int(out_first[-1])
    if not total:
        return np.zeros(0, np.uint64), out_first
    doc = np.repeat(np.arange(len(counts)), wins)
    at = first_word[doc] + (np.arange(total) - out_first[doc])
    have = np.minimum(counts, n)[doc]
    acc = have.astype(np.uint64)
    for k in range(n):
        part = h[np.minimum(at + k, len(h) - 1)]
        acc = acc * np.uint64(_P) + np.where(k < have, part, np.uint64(0))
    return mix(acc), out_first
