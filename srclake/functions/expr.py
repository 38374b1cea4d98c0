"""Scalar functions and predicates as column expressions (FN*, PRD*)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_SUFFIXES = (".c", ".cc", ".cpp", ".cxx")
HEADER_SUFFIXES = (".h", ".hh", ".hpp", ".hxx")
OBJECT_SUFFIXES = (".o", ".so", ".dll")
TOKEN = r"[\p{Lu}\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{Nd}\p{Pc}#]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def under(path, directory, raw_prefix: bool = False) -> Column:
    """PRD3: path lies under the directory; raw_prefix: any string prefix, `_` and `%` as wildcards."""
    if raw_prefix:
        return F.like(_c(path), F.concat(_c(directory), F.lit("%")))
    return (_c(path) == _c(directory)) | F.startswith(_c(path), F.concat(F.regexp_replace(_c(directory), "/$", ""), F.lit("/")))


def contains_ignore_case(text, part) -> Column:
    """PRD4, FN11."""
    return F.contains(F.lower(_c(text)), F.lower(_c(part)))


def matches_ignore_case(text, pattern: str) -> Column:
    """PRD5: case-insensitive regex search."""
    return _c(text).rlike(f"(?i){pattern}")


def matches_whole(text, pattern: str) -> Column:
    """SR14: the lower-cased value as a whole."""
    return F.lower(_c(text)).rlike(f"^(?:{pattern})$")


def has_flag(options, mask: int) -> Column:
    """PRD6."""
    return _c(options).bitwiseAND(F.lit(mask)) != 0


def before(line_a, col_a, line_b, col_b) -> Column:
    """PRD7: lexicographic order of positions."""
    return (_c(line_a) < _c(line_b)) | ((_c(line_a) == _c(line_b)) & (_c(col_a) < _c(col_b)))


def range_inside(a: str, b: str) -> Column:
    """PRD8: range a_* strictly inside b_* (structs with start_line, start_col, end_line, end_col)."""
    start = lambda r: F.struct(F.col(f"{r}.start_line"), F.col(f"{r}.start_col"))
    end = lambda r: F.struct(F.col(f"{r}.end_line"), F.col(f"{r}.end_col"))
    return F.when(start(a) == start(b), end(a) < end(b)).when(end(a) == end(b), start(b) < start(a)).otherwise((start(b) < start(a)) & (end(a) < end(b)))


def named(code, names: dict[int, str]) -> Column:
    """PRD12: name of an enumerated value."""
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[_c(code)]


def last_parts(path, n: int) -> Column:
    """PRD13: the last n parts of a path, after '...' if there are more."""
    parts = F.split(_c(path), "/")
    more = F.size(parts) - F.startswith(_c(path), F.lit("/")).cast("int") > n
    return F.when(more, F.concat(F.lit(".../"), F.array_join(F.slice(parts, -n, n), "/"))).otherwise(_c(path))


def extension(path) -> Column:
    return F.regexp_extract(F.lower(_c(path)), r"\.[^./]+$", 0)


def file_class(path) -> Column:
    """PRD14: source, header, object or other by extension."""
    e = extension(path)
    return F.when(e.isin(*SOURCE_SUFFIXES), "source").when(e.isin(*HEADER_SUFFIXES), "header").when(e.isin(*OBJECT_SUFFIXES), "object").otherwise("other")


def html_escape(text) -> Column:
    """FN4."""
    out = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def line_count(text) -> Column:
    """FN5: newlines + 1; null for an empty text."""
    t = _c(text)
    return F.when(t != "", F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1)


def without_blank_lines(text) -> Column:
    """FN6: lines of white space alone lose it if a newline follows, and runs of newlines become one."""
    bare = F.regexp_replace(_c(text), r"(^|\n)[ \t\r\x0B\x0C]+(?=\n)", "$1")
    return F.regexp_replace(bare, r"\n+", "\n")


def text_range(text, start_line, start_col, end_line, end_col) -> Column:
    """FN3: text of a range, lines and columns from 1, end column exclusive; empty if a bound is null."""
    lines = F.split(_c(text), "\n")
    a, b, c, d = map(_c, (start_line, start_col, end_line, end_col))
    one = F.substring(F.element_at(lines, a), b, d - b)
    first = F.substring(F.element_at(lines, a), b, F.length(_c(text)) + 1)
    middle = F.slice(lines, a + 1, c - a - 1)
    last = F.substring(F.element_at(lines, c), F.lit(1), d - 1)
    many = F.array_join(F.concat(F.array(first), middle, F.array(last)), "\n")
    known = a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull() & (a >= 1) & (c <= F.size(lines)) & (a <= c)
    return F.when(~known | known.isNull(), F.lit("")).when(a == c, one).otherwise(many)


def ancestors(path) -> Column:
    """FN8: the path's directories from the root down, without the path itself."""
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def parent(path) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def filename(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def directory_with_slash(path) -> Column:
    """FN9: what stands before the name, the last slash included."""
    return F.regexp_extract(_c(path), r"^(.*/)[^/]*$", 1)


def signature(name, email) -> Column:
    """FN12."""
    return F.format_string("%s (%s)", _c(name), _c(email))


def source_tokens(text) -> Column:
    """FN14: lower-cased tokens of letters, digits, connectors and #."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(f"({TOKEN})"), F.lit(1)), F.lower)


def space_tokens(text) -> Column:
    """FN15."""
    return F.filter(F.split(F.lower(_c(text)), r"\s+"), lambda x: x != "")


def kind_tokens(text) -> Column:
    """FN16: newline-separated kinds."""
    return F.split(_c(text), "\n")


def word_places(line, word: str) -> Column:
    """FN13: 1-based columns of whole-word matches of `word` in a line."""
    rx = rf"\b{re.escape(word)}\b"
    hits = F.split(_c(line), rx)
    size = len(word)
    starts = F.transform(F.slice(F.sequence(F.lit(1), F.size(hits)), F.lit(1), F.size(hits) - 1), lambda i: (F.aggregate(F.slice(hits, F.lit(1), i), F.lit(0), lambda acc, h: acc + F.length(h)) + (i - 1) * size + 1).cast("int"))
    return F.when(F.size(hits) > 1, starts).otherwise(F.array().cast("array<int>"))


def line_and_column(text, offset) -> Column:
    """FN17: (line, column) from 1 of a character offset from 0."""
    head = F.substring(_c(text), F.lit(1), _c(offset).cast("int"))
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    column = F.length(F.substring_index(head, "\n", -1)) + 1
    return F.struct(line.alias("line"), column.alias("column"))


def _fnv1a(texts: list[bytes]) -> np.ndarray:
    """Hashes of byte strings: all strings advance by one byte at a time, longest first."""
    size = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    at = (np.cumsum(size) - size)[order]
    h = np.full(len(texts), 0xCBF29CE484222325, np.uint64)
    live = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), side="right")
    for k, n in enumerate(live.tolist()):
        h[:n] = (h[:n] ^ data[at[:n] + k]) * np.uint64(0x100000001B3)
    out = np.empty(len(texts), np.uint64)
    out[order] = h
    return out.view(np.int64)


def fnv1a(column):
    """FN1: exact 64-bit FNV-1a of the UTF-8 bytes, as a signed long (Arrow batches; numpy across the rows)."""
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        known = s.notna()
        out = pd.Series(pd.NA, index=s.index, dtype="Int64")
        out[known] = _fnv1a([x.encode() for x in s[known]])
        return out

    return run(_c(column))


def sha1(text) -> Column:
    """FN2."""
    return F.sha1(_c(text))


def time_text(seconds, pattern: str = "EEE MMM d HH:mm:ss yyyy") -> Column:
    """FN18."""
    return F.date_format(F.timestamp_seconds(_c(seconds)), pattern)


def connection_parts(text) -> Column:
    """SNK2: the k=v;k=v part of system:k=v;k=v as a map."""
    return F.str_to_map(F.regexp_replace(_c(text), "^[^:]*:", ""), F.lit(";"), F.lit("="))


def connection_with(text, key: str, value) -> Column:
    """SNK2: the connection string with one part replaced or added."""
    system = F.regexp_extract(_c(text), "^([^:]*):", 1)
    merged = F.map_concat(F.map_filter(connection_parts(text), lambda k, v: k != key), F.create_map(F.lit(key), value if isinstance(value, Column) else F.lit(value)))
    pairs = F.transform(F.array_sort(F.map_keys(merged)), lambda k: F.concat(k, F.lit("="), merged[k]))
    return F.concat(system, F.lit(":"), F.array_join(pairs, ";"))


def path_tokens(path) -> Column:
    """FN10: the parts of a path."""
    return F.filter(F.split(_c(path), "/"), lambda p: p != "")


def as_json(*columns: str) -> Column:
    """FN19, SNK5: a row's columns as JSON."""
    return F.to_json(F.struct(*columns))
