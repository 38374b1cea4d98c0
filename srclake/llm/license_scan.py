"""License scans with DataFrame functions only: phrase places, and an exact set-similarity join of blocks and templates.

A text block starts at each line: LINES consecutive lines, and while these have fewer words after the first line than the
longest template, the next lines of the paragraph (up to a line without words).  So a notice that stands in one paragraph
is within the block of its first line, however narrowly it is wrapped.  A block holds a template if at least `threshold`
of the template's distinct words are among the block's.  The join orders the templates' words by the number
of documents they are in, rarest first.  A template of n words that needs a of them must share one of its n - a + 1
rarest with the block, and only those are joined (prefix filter); a block of fewer than a template words can't hold it
(length filter); and from the shared word on, a words must be left in the block's order (positional filter).  What
passes is verified on the sets, so nothing that meets the threshold is lost.

Every text is normalised once, for its phrase places and its template words, which are stored.  The same filters on
whole documents then choose the few texts that are read again and cut into blocks.

Defined results: a null text is empty: no words, no places, null first and last word, no labels, score 0.  Words,
places and blocks are those of the whole text, however long.  Repeated rows get a row each; labels are those of a row's
own text, also where rows share a doc_id or have none.  A notice cut by empty lines is found if it lies within LINES
lines.  Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _scratch

NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: (label, wording) of common notices; the wording is compared as a set of words.
TEMPLATES = [
    ("notice:apache-2.0", "licensed under the apache license version 2 0"),
    ("notice:cc-by-nc", "licensed under cc by nc 4 0"),
    ("notice:cc", "this work is licensed under a creative commons attribution license"),
    ("notice:gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("notice:mit", "released under the mit license"),
    ("text:apache-2.0", "you may not use this file except in compliance with the license"),
    ("text:bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("text:gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("text:mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("text:mpl", "this source code form is subject to the terms of the mozilla public license"),
]
#: Lines that a block has at least.
LINES = 3
#: The templates' words are sent to all executors, so there may be no more.
MOST_WORDS = 10_000
#: Rows of 8 bytes that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """The text's words, lower-cased in A-Z."""
    text = F.coalesce(text, F.lit(""))
    # lower() is faster, and makes ASCII letters of these two only
    low = F.when(text.contains("\u0130") | text.contains("\u212a"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, NON_WORD), "")


def phrase_places(docs: DataFrame, phrases: dict[str, str], norm: str = "norm") -> DataFrame:
    """Adds n_base, first_word, last_word and base (labels) from the words with one space before, between and after."""
    n = F.col(norm)
    either = "|".join(re.escape(p) for p in phrases)
    hit = F.lit(False)
    for p in phrases:
        hit = hit | n.contains(f" {p} ")
    count = sum((F.when(n.contains(f" {p} "), F.regexp_count(n, F.lit(rf" (?={re.escape(p)} )"))).otherwise(0) for p in phrases), F.lit(0))
    before = lambda part: (F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))).cast("long")
    first = before(F.regexp_extract(n, rf"(?s)^(.*?) (?:{either}) ", 1))
    last = before(F.regexp_extract(n, rf"(?s)^(.*) (?:{either}) ", 1))
    labels = F.array_compact(F.array(*(F.when(n.contains(f" {p} "), F.lit(label)) for p, label in phrases.items())))
    return docs.withColumns({"n_base": F.when(hit, count).otherwise(0).cast("long"), "first_word": F.when(hit, first), "last_word": F.when(hit, last), "base": F.when(hit, labels).otherwise(F.array().cast("array<string>"))})


def line_blocks(lines: Column, longest: int) -> Column:
    """The blocks' words with spaces between.  lines: an array of (words with spaces between, number of words)."""

    def add(acc: Column, line: Column) -> Column:
        open_ = acc["open"] & (line["n"] > 0)
        take = (acc["k"] < LINES - 1) | (open_ & (acc["n"] < longest))
        more = F.struct(F.concat_ws(" ", acc["text"], line["words"]).alias("text"), (acc["n"] + line["n"]).alias("n"), (acc["k"] + 1).alias("k"), open_.alias("open"))
        return F.when(take, more).otherwise(F.struct(acc["text"].alias("text"), acc["n"].alias("n"), acc["k"].alias("k"), F.lit(False).alias("open")))

    start = lambda line: F.struct(line["words"].alias("text"), F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(True).alias("open"))
    # each further line has a word at least, so `longest` lines are enough
    return F.transform(lines, lambda line, i: F.aggregate(F.slice(lines, i + 2, F.lit(max(longest, LINES))), start(line), add, lambda acc: acc["text"]))


def template_index(templates: DataFrame, order: list[str], threshold: float) -> DataFrame:
    """Each template's words in global order: label, word, position (from 1), size, need, in_prefix, wording."""
    words = templates.select("label", F.array_intersect(F.array(*map(F.lit, order)), words_of(F.col("wording"))).alias("wording"))
    sized = words.withColumn("size", F.size("wording")).where("size > 0")
    sized = sized.withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("size") * threshold - 1e-9).cast("int")))
    out = sized.select("label", "size", "need", "wording", F.posexplode("wording").alias("position", "word")).withColumn("position", F.col("position") + 1)
    return out.withColumn("in_prefix", F.col("position") <= F.col("size") - F.col("need") + 1)


def containment_join(blocks: DataFrame, index: DataFrame, *key: str) -> DataFrame:
    """key, label and containment of all blocks that meet the threshold.  blocks: key, words (distinct template words,
    in global order)."""
    heads = F.broadcast(index.where("in_prefix").drop("position", "in_prefix"))  # MOST_WORDS rows
    tokens = blocks.select(*key, "words", F.posexplode("words").alias("at", "word"))
    # length and positional filter: the words from this one on
    met = tokens.join(heads, "word").where(F.size("words") - F.col("at") >= F.col("need"))
    pairs = met.drop("at", "word").dropDuplicates([*key, "label"])
    verified = pairs.withColumn("overlap", F.size(F.array_intersect("wording", "words"))).where("overlap >= need")
    return verified.select(*key, "label", (F.col("overlap") / F.col("size")).alias("containment"))


def scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.8, text_col: str = "text", id_col: str = "doc_id", lines: int | None = None) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base (labels), found (labels), best (largest containment).  A
    number of lines makes all blocks as long."""
    spark = documents.sparkSession
    vocabulary = sorted({w for _, t in templates for w in re.sub(NON_WORD, " ", t.translate(str.maketrans(UPPER, LOWER))).split(" ") if w})
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"the templates have {len(vocabulary)} words, {MOST_WORDS} at most are allowed")
    in_order = lambda words, order: F.array_intersect(F.array(*map(F.lit, order)).cast("array<string>"), words)
    docs = documents.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    one = docs.select("row", "id", F.explode(F.array(words_of(F.col("text")))).alias("all"))
    one = one.select("row", "id", F.size("all").cast("long").alias("n_words"), F.explode(F.array(F.struct(F.concat(F.lit(" "), F.array_join("all", " "), F.lit(" ")).alias("norm"), in_order(F.col("all"), vocabulary).alias("words")))).alias("w"))
    base = phrase_places(one.select("row", "id", "n_words", "w.norm", "w.words"), phrases).drop("norm")
    base = _scratch.saved(base, "places", "snappy")

    seen = {r["word"]: r["df"] for r in base.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()}  # MOST_WORDS rows
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    index = template_index(spark.createDataFrame(templates, "label string, wording string"), order, threshold)
    whole = base.where(F.size("words") > 0).select("row", in_order(F.col("words"), order).alias("words"))
    maybe = _scratch.saved(containment_join(whole, index, "row").select("row").distinct(), "maybe", "snappy")
    small = F.broadcast if maybe.count() <= BROADCAST_ROWS else (lambda df: df)
    texts = docs.select("row", "text").join(small(maybe), "row", "left_semi")
    split = texts.select("row", F.explode(F.array(F.split("text", "\n"))).alias("all"))
    if lines is None:
        longest = max((len([w for w in re.split(NON_WORD, t) if w]) for _, t in templates), default=0)
        counted = lambda x: F.struct(F.array_join(words_of(x), " ").alias("words"), F.size(words_of(x)).alias("n"))
        split = split.select("row", F.explode(F.array(F.transform("all", counted))).alias("all"))  # each line's words once
        cut = split.select("row", F.posexplode(line_blocks(F.col("all"), longest)).alias("block", "text"))
    else:
        cut = split.select("row", F.posexplode(F.transform("all", lambda _, i: F.array_join(F.slice(F.col("all"), i + 1, F.lit(lines)), " "))).alias("block", "text"))
    blocks = cut.select("row", "block", in_order(words_of(F.col("text")), order).alias("words"))
    found = containment_join(blocks, index, "row", "block")
    labels = found.groupBy("row").agg(F.sort_array(F.collect_set("label")).alias("found"), F.max("containment").alias("best"))
    out = base.join(labels, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base", F.coalesce("found", F.array().cast("array<string>")).alias("found"), F.coalesce("best", F.lit(0.0)).alias("best"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    d = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.col("best")).alias("score"),
    )


_NORMAL = r"""' ' || trim(regexp_replace(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') || ' '"""
_EITHER = "|".join(PHRASES)
_LONGEST = max(len(t.split(" ")) for _, t in TEMPLATES)
OP5_SQL = f"""
WITH r AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT r, doc_id, {_NORMAL.format("text")} AS n, text FROM r),
w AS (SELECT r, doc_id, n, CASE WHEN n = '  ' THEN [] ELSE string_split(trim(n, ' '), ' ') END AS ws FROM d),
p(phrase, label) AS (VALUES {", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())}),
places AS (
  SELECT r, label, i FROM (SELECT r, ws, n FROM w WHERE regexp_matches(n, ' ({_EITHER}) ')) x,
         p, unnest(range(0, len(ws))) u(i)
  WHERE list_slice(ws, i + 1, i + len(string_split(phrase, ' '))) = string_split(phrase, ' ')
),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS base FROM places GROUP BY r),
t(label, wording) AS (VALUES {", ".join(f"('{label}', '{t}')" for label, t in TEMPLATES)}),
tw AS (SELECT label, list_distinct(string_split(wording, ' ')) AS tws FROM t),
s AS (SELECT r, [trim({_NORMAL.format("x")}, ' ') FOR x IN string_split(text, chr(10))] AS ls FROM d),
ln AS (SELECT r, unnest(range(1, len(ls) + 1)) AS i, unnest([CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END FOR x IN ls]) AS n FROM s),
c AS (
  SELECT r, i, n, sum(n) OVER (PARTITION BY r ORDER BY i) AS cum,
         min(CASE WHEN n = 0 THEN i END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS blank FROM ln
),
e AS (
  SELECT a.r, a.i, greatest(a.i + {LINES - 1}, least(coalesce(b.i, 1000000000), coalesce(a.blank - 1, 1000000000))) AS e
  FROM c a ASOF LEFT JOIN (SELECT r, i, cum FROM c WHERE n > 0) b ON a.r = b.r AND a.cum + {_LONGEST} <= b.cum
),
k AS (SELECT r, array_to_string(list_slice(ls, i, e), ' ') AS block FROM e JOIN s USING (r)),
l AS (SELECT r, list_distinct(string_split(trim({_NORMAL.format("block")}, ' '), ' ')) AS lws FROM k),
m AS (
  SELECT r, label, CAST(len(list_intersect(lws, tws)) AS DOUBLE) / len(tws) AS c
  FROM l, tw WHERE len(list_intersect(lws, tws)) >= ceil(len(tws) * 0.8 - 1e-9)
),
f AS (SELECT r, list_distinct(list(label)) AS found, max(c) AS best FROM m GROUP BY r)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels,
       CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN f USING (r)
"""
