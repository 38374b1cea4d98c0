"""Text and definition search over a postings table (SR*, SRC16)."""

from __future__ import annotations

import functools
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr

MAX_GAP = 20
MIN_TERMS = 2
HIT_LIMIT = 100
WEIGHTS = {"Type": 5, "Function": 4, "Field": 3}


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """SRC16: term, doc, position (from 0)."""
    return docs.select(doc, F.posexplode(expr.source_tokens(text)).alias("position", "term"))


def any_of(posts: DataFrame, terms: list[str], doc: str = "doc_id") -> DataFrame:
    """SR1: documents with any of the terms, and how many of them they hold."""
    return posts.where(F.col("term").isin(*terms)).groupBy(doc).agg(F.countDistinct("term").alias("terms"), F.count("*").alias("hits"))


def boolean(posts: DataFrame, must: list[str], must_not: list[str] = (), should: list[str] = (), doc: str = "doc_id") -> DataFrame:
    """SR2: all of must, none of must_not, and if there is no must at least one of should."""
    has = posts.where(F.col("term").isin(*must, *must_not, *should)).groupBy(doc).agg(*(F.max(F.col("term") == t).alias(f"t{i}") for i, t in enumerate([*must, *must_not, *should])))
    cond = F.lit(True)
    for i in range(len(must)):
        cond = cond & F.col(f"t{i}")
    for i in range(len(must), len(must) + len(must_not)):
        cond = cond & ~F.col(f"t{i}")
    if not must:
        some = F.lit(False)
        for i in range(len(must_not), len(must_not) + len(should)):
            some = some | F.col(f"t{i}")
        cond = cond & some
    return has.where(cond).select(doc)


def phrase(posts: DataFrame, terms: list[str], doc: str = "doc_id") -> DataFrame:
    """SR3: (document, position) where the terms stand in a row: offset-adjusted positions that all terms share."""
    offsets = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(i).alias("k")) for i, t in enumerate(terms)))
    p = posts.where(F.col("term").isin(*terms)).select(doc, "position", F.explode(F.filter(offsets, lambda o: o["term"] == F.col("term"))).alias("o"))
    return p.groupBy(doc, (F.col("position") - F.col("o.k")).alias("position")).agg(F.countDistinct("o.k").alias("n")).where(F.col("n") == len(terms)).select(doc, "position")


def _by_dictionary(posts: DataFrame, cond: Column, doc: str) -> DataFrame:
    wanted = posts.select("term").distinct().where(cond)
    return posts.join(wanted, "term", "left_semi").groupBy(doc).agg(F.count("*").alias("hits"))


def like_pattern(pattern: str) -> str:
    """SR4: a pattern of ? and * as one of LIKE."""
    return pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")


def wildcard(posts: DataFrame, pattern: str, doc: str = "doc_id") -> DataFrame:
    """SR4: ? and *, also leading."""
    return _by_dictionary(posts, F.col("term").like(like_pattern(pattern.lower())), doc)


def regex(posts: DataFrame, pattern: str, doc: str = "doc_id") -> DataFrame:
    """SR5: a term as a whole."""
    return _by_dictionary(posts, F.col("term").rlike(f"^(?:{pattern})$"), doc)


def fuzzy(posts: DataFrame, term: str, edits: int = 2, doc: str = "doc_id") -> DataFrame:
    """SR5."""
    return _by_dictionary(posts, F.levenshtein(F.col("term"), F.lit(term), edits) >= 0, doc)


def term_range(posts: DataFrame, low: str, high: str, doc: str = "doc_id") -> DataFrame:
    """SR5."""
    return _by_dictionary(posts, F.col("term").between(low, high), doc)


def prefix(posts: DataFrame, start: str, doc: str = "doc_id") -> DataFrame:
    """SR5."""
    return _by_dictionary(posts, F.startswith(F.col("term"), F.lit(start)), doc)


def definition_search(tags: DataFrame, terms: list[tuple[str | None, str]], doc: str = "doc_id") -> DataFrame:
    """SR6: tags (doc, name, kind, line) that a definition query shows.  terms: (kind or None for any, pattern of ? and *).

    A document is found by any term, within the term's kind.  Of a found document the tags that some pattern fits are
    shown; the kinds asked for are remembered, and once there is one, tags of other kinds aren't shown."""
    if not terms:
        return tags.limit(0)
    fits = lambda pattern: F.lower("name").like(like_pattern(pattern.lower()))
    any_ = lambda conds: functools.reduce(lambda x, y: x | y, conds)
    hit = any_([fits(p) & (F.col("kind") == k) if k is not None else fits(p) for k, p in terms])
    found = tags.where(hit).select(doc).distinct()
    kinds = [k for k, _ in terms if k is not None]
    shown = tags.where(any_([fits(p) for _, p in terms]))
    return (shown.where(F.col("kind").isin(*kinds)) if kinds else shown).join(found, doc, "left_semi")


def definitions(tags: DataFrame, term: str, kinds: list[str] | None = None) -> DataFrame:
    """SR6: tags (doc_id, name, kind, line) of a name, by kind."""
    t = tags.where(F.lower("name") == term.lower())
    return t if not kinds else t.where(F.col("kind").isin(*kinds))


def proximity_matches(places: list[list[int]], max_gap: int = MAX_GAP, min_terms: int = MIN_TERMS, swapped: bool = True) -> list[tuple[int, int, float]]:
    """SR8: (first, last, score) of the matches in one document.  places: ascending positions of each query term.

    Every term stands at one of its positions, no two at the same.  From the lowest on, terms belong to a match while
    the next one is at most max_gap away; then the lowest moves on to its next position, and so forth, as long as
    enough terms are left to beat the best match's size.  If order counts, terms that step back are left out.  The score
    is n + 1 less the mean over all pairs of (distance in the document - distance in the query)^2, in units of
    ((Q - 1)(max_gap + 1))^2."""
    at = {t: 0 for t, ps in enumerate(places) if ps}
    unit = max(1, (len(places) - 1) * (max_gap + 1)) ** 2
    out: list[tuple[int, int, float]] = []
    best, size = 0.0, 0

    def settle() -> list[tuple[int, int]]:
        while True:
            taken: dict[int, int] = {}
            clash = None
            for t in sorted(at):
                p = places[t][at[t]]
                if p in taken:
                    clash = t
                    break
                taken[p] = t
            if clash is None:
                return sorted(taken.items())
            step(clash)

    def step(t: int) -> None:
        at[t] += 1
        if at[t] == len(places[t]):
            del at[t]

    while len(now := settle()) >= max(min_terms, size):
        run = [now[0]]
        for p, t in now[1:]:
            if p - run[-1][0] > max_gap:
                break
            run.append((p, t))
        if len(run) >= min_terms:
            if not swapped:
                kept = run[:1]
                for p, t in run[1:]:
                    if t >= kept[-1][1]:
                        kept.append((p, t))
                run = kept
            n = len(run)
            if n >= min_terms:
                off = sum(((q - p) - (u - t)) ** 2 for i, (p, t) in enumerate(run) for q, u in run[i + 1 :]) / (n * (n - 1) / 2)
                value = n + 1 - off / unit
                if value > 0:
                    out.append((run[0][0], run[-1][0], value))
                if value > best:
                    best, size = value, n
        step(now[0][1])
    return out


def proximity_all(posts: DataFrame, terms: list[str], doc: str = "doc_id", max_gap: int = MAX_GAP, min_terms: int = MIN_TERMS, swapped: bool = True) -> DataFrame:
    """SR7, SR8: all matches of each document: doc, first, last, score.  Fewer than two terms find nothing.

    Only positions of the query's terms are gathered, one document's in a row."""
    kind = f"{doc} {posts.schema[doc].dataType.simpleString()}, first int, last int, score double"
    if len(terms) < 2:
        return posts.sparkSession.createDataFrame([], kind)
    hits = posts.where(F.col("term").isin(*terms)).groupBy(doc).agg(F.collect_list(F.struct("term", "position")).alias("hits"))

    def run(batches):
        for pdf in batches:
            out = []
            for ident, found in zip(pdf[doc], pdf["hits"], strict=True):
                places: dict[str, list[int]] = {t: [] for t in terms}
                for h in found:
                    places[h["term"]].append(h["position"])
                out += [(ident, *m) for m in proximity_matches([sorted(places[t]) for t in terms], max_gap, min_terms, swapped)]
            yield pd.DataFrame(out, columns=[doc, "first", "last", "score"])

    return hits.mapInPandas(run, kind)


def proximity(posts: DataFrame, terms: list[str], doc: str = "doc_id", max_gap: int = MAX_GAP, min_terms: int = MIN_TERMS, swapped: bool = True) -> DataFrame:
    """SR8: the best match of each document, the first of equal ones."""
    found = proximity_all(posts, terms, doc, max_gap, min_terms, swapped)
    best = found.groupBy(doc).agg(F.max_by(F.struct("first", "last", "score"), F.struct("score", -F.col("first"), -F.col("last"))).alias("m"))
    return best.select(doc, "m.*")


def log_query(line: str) -> list[str]:
    """SR7: the terms of a pasted log line, by the pattern of the postings, repeats too; fewer than MIN_TERMS find
    nothing."""
    import regex

    found = [t.lower() for t in regex.findall(expr.TOKEN, line)]
    return found if len(found) >= MIN_TERMS else []


def without_overlaps(matches: DataFrame, doc: str = "doc_id", start: str = "first", end: str = "last") -> DataFrame:
    """SR9: by start, a match that contains its successor goes."""
    w = Window.partitionBy(doc).orderBy(start, end)
    return matches.withColumn("_e", F.lead(end).over(w)).where(F.col("_e").isNull() | (F.col("_e") > F.col(end))).drop("_e")


def token_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens with their line (from 1) and ordinal in it."""
    lines = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("line", "_l"))
    return lines.select(doc, (F.col("line") + 1).alias("line"), F.posexplode(expr.source_tokens("_l")).alias("ordinal", "term"))


def line_matches(tokens: DataFrame, terms: list[str], doc: str = "doc_id") -> DataFrame:
    """SR10: runs of neighbouring matching tokens on a line: doc, line, first, last (ordinals), tokens."""
    hit = tokens.where(F.col("term").isin(*terms))
    w = Window.partitionBy(doc, "line").orderBy("ordinal")
    runs = hit.withColumn("_g", F.col("ordinal") - F.row_number().over(w))
    return runs.groupBy(doc, "line", "_g").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("tokens")).drop("_g")


def near_best(matches: DataFrame, max_diff: float = 0.0, doc: str = "doc_id") -> DataFrame:
    """SR12."""
    return matches.withColumn("_b", F.max("score").over(Window.partitionBy(doc))).where(F.col("score") >= F.col("_b") - max_diff).drop("_b")


def boost(path, parsed) -> Column:
    """SR13: 2 for source files, else 1, and 1 more if parsed."""
    return F.when(expr.file_class(path) == "source", 2).otherwise(1) + F.when(parsed, 1).otherwise(0)


def relevance(posts: DataFrame, terms: list[str], n_docs: int, doc: str = "doc_id") -> DataFrame:
    """SR19: TF-IDF sum (match sets agree with the reference, ranking is our own).  What is broadcast has a row for each
    query term."""
    tf = posts.where(F.col("term").isin(*terms)).groupBy(doc, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return tf.join(F.broadcast(df), "term").groupBy(doc).agg(F.sum(F.sqrt("tf") * (1 + F.log(F.lit(n_docs) / (F.col("df") + 1)))).alias("score"))


def top(scored: DataFrame, start: int = 0, end: int = HIT_LIMIT, doc: str = "doc_id") -> DataFrame:
    """SO7: hits start..end of the first HIT_LIMIT by score."""
    best = scored.orderBy(F.desc("score"), doc).limit(HIT_LIMIT)
    return best.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("score"), doc))).where((F.col("_n") > start) & (F.col("_n") <= end)).drop("_n")


def files_by_regex(files: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """SR15: files whose name the regex finds."""
    return files.where(expr.matches_ignore_case(expr.filename(path), pattern))


def directory_page(files: DataFrame, offset: int, limit: int, path: str = "path") -> DataFrame:
    """SO8: the files of directories offset + 1 .. offset + limit, by name."""
    dirs = files.select(expr.parent(path).alias("dir")).distinct().orderBy("dir").offset(offset).limit(limit)
    return files.withColumn("dir", expr.parent(path)).join(dirs, "dir", "left_semi")


def files_by_substring(files: DataFrame, part: str, path: str = "path") -> DataFrame:
    """SR16."""
    return files.where(expr.contains_ignore_case(path, F.lit(part)))


def suggest_names(names: DataFrame, typed: str, edits: int = 1, limit: int = 5, name: str = "name") -> DataFrame:
    """SR17: names whose beginning is within some edits of what was typed."""
    n = names.select(F.lower(name).alias("name")).distinct()
    d = F.levenshtein(F.substring("name", 1, len(typed)), F.lit(typed.lower()))
    return n.withColumn("distance", d).where(F.col("distance") <= edits).orderBy("distance", "name").limit(limit)


def suggest_symbols(tags: DataFrame, typed: str, limit: int = 5) -> DataFrame:
    """SR17: symbols with a token that starts with what was typed, by weight of kind."""
    w = F.coalesce(expr.named(F.col("kind"), WEIGHTS), F.lit(1))
    hit = tags.where(F.exists(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), lambda t: F.startswith(t, F.lit(typed.lower()))))
    return hit.groupBy("name").agg(F.max(w).alias("weight")).orderBy(F.desc("weight"), "name").limit(limit)


def valid_regex(pattern: str) -> bool:
    """SR18."""
    import re

    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def boosted(scored: DataFrame, files: DataFrame, doc: str = "doc_id") -> DataFrame:
    """SR13: scores times the boost of each document's file.  files: doc, path, parsed."""
    b = files.select(doc, boost(F.col("path"), F.col("parsed")).alias("_b"))
    return scored.join(b, doc).withColumn("score", F.col("score") * F.col("_b")).drop("_b")


SEARCH_TYPES = ["Text search", "Definition search", "File name search", "Log search"]


def matched(*matches: DataFrame, doc: str = "doc_id") -> DataFrame:
    """SR11: line matches of several matchers together; a document without any is in none of them and so drops out."""
    out = matches[0].select(doc, "line", "first", "last")
    for m in matches[1:]:
        out = out.unionByName(m.select(doc, "line", "first", "last"))
    return out.distinct()
