"""A stored search index in segments: postings with positions and character offsets, a term dictionary with grams and
deletion neighbourhoods, lines and documents (SRC16, SRC19, SR1-SR5, SR7-SR10, SR13, SR17, SR20).

Every part (a field's postings and dictionary, the lines, the documents) is a list of segment folders; a manifest names
the live ones, and one new manifest commits a change as a whole.  Files hold all postings of some documents in order of
terms, so a query for a few terms reads the row groups of each that hold them, and a frequent term is many tasks'.  The
dictionary of a segment is made of its postings by the first query that needs it.
Wildcard, regex and fuzzy queries find their terms in the dictionary: by grams of three characters that a match must
hold, or by the strings that deleting up to two of a prefix's characters leaves; only what these tables yield is tested.

Adding field values writes a small segment, and tombstones that void the documents' older postings, of that field alone.
A merge rewrites the parts that have tombstones, no others.

Document ids must be unique and not null (others are left out).  Null fields have no terms.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import expr
from . import search

#: Analyzers by field: how a field's text becomes terms.
FIELDS = {
    "content": expr.source_tokens,
    "path": expr.path_tokens,
    "name": lambda c: F.array(F.lower(c)),
    "dir": expr.path_tokens,
    "mime": lambda c: F.array(c),
    "definition": expr.space_tokens,
}
LINES, DOCUMENTS = "lines", "documents"
POSTINGS, TERMS, GRAMS, EDGES = "postings", "terms", "grams", "edges"
#: Marks of a term's beginning and end in grams of GRAM characters.
BEGIN, END, GRAM = "\x02", "\x03", 3
#: Prefixes of up to PREFIX characters have neighbourhoods of up to EDITS deletions.
PREFIX, EDITS = 7, 2
#: Terms or prefixes that go into a filter; more are joined.
SENT = 1000
#: Characters of a document that line matching can be told to stop at; by itself it looks at all.
ANALYSED = 500 * 1024
#: Characters in a block of the line lookup.
BLOCK = 512
ROW_GROUP = 4 << 20


def content_terms(docs: DataFrame, doc: str = "doc_id", text: str = "content") -> DataFrame:
    """doc, term, position, start, end: the tokens of a text and their character offsets (from 0; end exclusive).

    A text's gaps and tokens alternate, so offsets are running sums of their lengths (`posexplode` would have Spark add a
    filter that finds them again).  Documents are dealt out before they are taken apart, and one's tokens stay where it
    went."""
    d = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("t")).repartition("doc")
    tokens = F.regexp_extract_all("t", F.lit(f"({expr.TOKEN})"), F.lit(1))
    both = F.arrays_zip(F.transform(F.split("t", expr.TOKEN), F.length).alias("gap"), tokens.alias("token"))
    rows = d.select("doc", F.posexplode_outer(both).alias("position", "x")).select("doc", "position", F.col("x.gap").alias("gap"), F.col("x.token").alias("token")).where("token IS NOT NULL")
    w = Window.partitionBy("doc").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("token")).over(w).cast("int"))
    return rows.select(F.col("doc").alias(doc), F.lower("token").alias("term"), "position", (F.col("end") - F.length("token")).alias("start"), "end")


def field_terms(docs: DataFrame, field: str, doc: str = "doc_id") -> DataFrame:
    """doc, term, position, start, end of a field; offsets are null but for the content."""
    if field == "content":
        return content_terms(docs, doc)
    none = F.lit(None).cast("int")
    rows = docs.where(F.col(doc).isNotNull() & F.col(field).isNotNull()).select(doc, F.posexplode(FIELDS[field](F.col(field))).alias("position", "term"))
    return rows.where("term IS NOT NULL").select(doc, "term", "position", none.alias("start"), none.alias("end"))


def line_table(docs: DataFrame, doc: str = "doc_id", text: str = "content") -> DataFrame:
    """doc, line (from 1), start (offset of its first character), next (that of the line after it), text."""
    d = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("t")).repartition("doc")
    rows = d.select("doc", F.posexplode(F.split("t", "\n")).alias("n", "text"))
    w = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("next", F.sum(F.length("text") + 1).over(w).cast("int"))
    return rows.select(F.col("doc").alias(doc), (F.col("n") + 1).alias("line"), (F.col("next") - F.length("text") - 1).alias("start"), "next", "text")


def located(hits: DataFrame, lines: DataFrame, offset: str, doc: str = "doc_id", line: str = "line", column: str = "column") -> DataFrame:
    """Adds line and column (from 1) of an offset: the last line that starts at or before it.

    Lines are dealt to the blocks of BLOCK characters that they reach into, so a lookup meets the lines of one block."""
    blocks = lines.select(F.col(doc).alias("_doc"), F.col("line").alias(line), F.col("start").alias("_start"), F.col("next").alias("_next"), F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("next") - 1) / BLOCK))).alias("_block"))
    h = hits.withColumn("_b", F.floor(F.col(offset) / BLOCK))
    on = (F.col(doc) == F.col("_doc")) & (F.col("_b") == F.col("_block")) & (F.col("_start") <= F.col(offset)) & (F.col(offset) < F.col("_next"))
    return h.join(blocks, on).withColumn(column, F.col(offset) - F.col("_start") + 1).drop("_doc", "_start", "_next", "_block", "_b")


def line_runs(hits: DataFrame, lines: DataFrame, doc: str = "doc_id", analysed: int | None = None) -> DataFrame:
    """SR10: neighbouring matching tokens on a line are one match: doc, line, start_col, end_col (exclusive), tokens.

    hits: doc, position, start, end.  Tokens that begin beyond `analysed` characters don't count, if it is given."""
    some = hits if analysed is None else hits.where(F.col("start") < analysed)
    at = located(some.select(doc, "position", "start", "end").distinct(), lines, "start", doc, "line", "start_col")
    w = Window.partitionBy(doc).orderBy("position")
    runs = at.withColumn("_g", F.col("position") - F.row_number().over(w)).withColumn("end_col", F.col("start_col") + F.col("end") - F.col("start"))
    return runs.groupBy(doc, "line", "_g").agg(F.min("start_col").alias("start_col"), F.max("end_col").alias("end_col"), F.count("*").alias("tokens")).drop("_g")


def spans(matches: DataFrame, hits: DataFrame, lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """SR20: (line, column) of the first term's beginning and the last term's end of proximity matches (first and last
    positions), best score first."""
    places = hits.select(F.col(doc), "position", "start", "end").distinct()
    m = matches.join(places.select(doc, F.col("position").alias("first"), F.col("start").alias("start_offset")), [doc, "first"]).join(places.select(doc, F.col("position").alias("last"), F.col("end").alias("end_offset")), [doc, "last"])
    m = located(m, lines, "start_offset", doc, "first_line", "first_col")
    return located(m, lines, "end_offset", doc, "last_line", "last_col").orderBy(F.desc("score"), doc, "first")


# --- dictionary ---------------------------------------------------------------------------------------------------


def grams_of(term: Column) -> Column:
    marked = F.concat(F.lit(BEGIN), term, F.lit(END))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - GRAM + 1, F.lit(1))), lambda i: F.substring(marked, i, F.lit(GRAM))))


def _less_one(s: Column) -> Column:
    cut = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    return F.when(F.length(s) > 0, cut).otherwise(F.array().cast("array<string>"))


def neighbours(prefix: Column) -> Column:
    """What deleting up to EDITS characters leaves.  Two strings within that edit distance share one of these, and so do
    their prefixes of equal length."""
    sets = [F.array(prefix)]
    for _ in range(EDITS):
        sets.append(F.flatten(F.transform(sets[-1], _less_one)))
    return F.array_distinct(F.concat(*sets))


def _deleted(s: str, edits: int) -> list[str]:
    out = {s}
    for _ in range(edits):
        out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
    return sorted(out)


def wildcard_pieces(pattern: str) -> list[str]:
    """The literal runs of a wildcard pattern, with marks where it is anchored."""
    out = re.split(r"[*?]", BEGIN + pattern + END)
    return [p for p in out if p]


def regex_pieces(pattern: str) -> list[str]:
    """Literal runs that every whole match of a pattern holds, in its order; none if there are alternatives outside
    brackets.  Brackets, classes and what may repeat or be missing break a run."""
    runs, run, i = [], BEGIN, 0

    def end():
        nonlocal run
        if run:
            runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "|":
            return []
        step, literal = 1, c
        if c == "\\":
            literal, step = (pattern[i + 1] if i + 1 < len(pattern) and not pattern[i + 1].isalnum() else ""), 2
            if not literal:
                return []  # classes, references, quotes
        elif c == "(":
            depth, j = 0, i
            while j < len(pattern):
                if pattern[j] == "\\":
                    j += 1
                elif pattern[j] == "[":
                    j = _class_end(pattern, j)
                elif pattern[j] == "(":
                    depth += 1
                elif pattern[j] == ")":
                    depth -= 1
                    if not depth:
                        break
                j += 1
            if pattern[i + 1 : i + 2] == "?" and pattern[i + 2 : i + 3] != ":":
                return []  # flags, look-around
            literal, step = "", j - i + 1
        elif c == "[":
            literal, step = "", _class_end(pattern, i) - i + 1
        elif c in ".^$":
            literal = ""
        after = pattern[i + step : i + step + 1]
        if after in ("?", "*", "+", "{") and after:
            if literal and after == "+":
                run += literal
            end()
            j = i + step + 1
            if after == "{":
                j = pattern.find("}", j) + 1 or len(pattern)
            while j < len(pattern) and pattern[j] in "?+":
                j += 1
            i = j
            continue
        if literal:
            run += literal
        else:
            end()
        i += step
    run += END
    end()
    return runs


def _class_end(pattern: str, i: int) -> int:
    j = i + 1 + (pattern[i + 1 : i + 2] == "^")
    j += pattern[j : j + 1] == "]"
    while j < len(pattern) and pattern[j] != "]":
        j += 2 if pattern[j] == "\\" else 1
    return j


def required_grams(pieces: list[str]) -> list[str]:
    return sorted({p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})


# --- segments -----------------------------------------------------------------------------------------------------


def _put(df: DataFrame, path: str, *order: str) -> None:
    """Rows where they are, each file in order, so that a filter on its first columns reads few row groups of a file."""
    df.sortWithinPartitions(*order).write.option("parquet.block.size", ROW_GROUP).parquet(path)


FIELD = "field"


def _dictionary(spark: SparkSession, path: str, table: str, field: str, doc: str) -> str:
    """The path of a dictionary table (TERMS, GRAMS or EDGES) of a segment's field, which is written when it is first asked
    for.  Segments don't change, so the table stays right; of two that write it at once the first one's is taken."""
    done = f"{path}/{table}/{FIELD}={field}"
    if store.listed(spark, done):
        return done
    if table == TERMS:
        per_doc = spark.read.parquet(f"{path}/{POSTINGS}/{FIELD}={field}").groupBy("term", doc).agg(F.count("*").alias("hits"))
        rows, order = per_doc.groupBy("term").agg(F.count("*").alias("docs"), F.sum("hits").alias("hits")), ["term"]
    else:
        words = spark.read.schema("term string, docs long, hits long").parquet(_dictionary(spark, path, TERMS, field, doc)).select("term")
        if table == GRAMS:
            rows, order = words.select(F.explode(grams_of(F.col("term"))).alias("gram"), "term"), ["gram", "term"]
        else:
            starts = words.select(F.explode(F.sequence(F.lit(1), F.lit(PREFIX))).alias("length"), "term").select("length", F.expr("substring(term, 1, length)").alias("prefix")).distinct()
            rows, order = starts.select("length", F.explode(neighbours(F.col("prefix"))).alias("key"), "prefix"), ["key", "length", "prefix"]
    draft = f"{done}-{uuid.uuid4().hex}"
    _put(rows, draft, *order)
    store.renamed(spark, draft, done)
    return done


def _write_field(terms: DataFrame, path: str, field: str, doc: str) -> None:
    """The postings of a field.

    A document's are in one place, as they were made: files hold all terms of some documents, so writing moves nothing
    but texts, and a frequent term is many tasks'."""
    _put(terms, f"{path}/{POSTINGS}/{FIELD}={field}", "term", doc, "position")


def _write_segment(docs: DataFrame, folder: str, doc: str) -> dict[str, str]:
    """The path of each part that docs has columns for."""
    fields = [f for f in FIELDS if f in docs.columns]
    parts = {}
    if fields:
        path = f"{folder}/fields-{uuid.uuid4().hex}"
        for f in fields:
            _write_field(field_terms(docs, f, doc), path, f, doc)
        parts = dict.fromkeys(fields, path)
    if "content" in fields:
        parts[LINES] = f"{folder}/{LINES}-{uuid.uuid4().hex}"
        _put(line_table(docs, doc), parts[LINES], doc, "line")
    return parts


def build(docs: DataFrame, folder: str, doc: str = "doc_id") -> Index:
    """SRC16: writes the index of docs (doc, and of path, name, dir, mime, content, definition, parsed what there is)."""
    parts = {part: [[0, path]] for part, path in _write_segment(docs, folder, doc).items()}
    parts[DOCUMENTS] = [[0, path := f"{folder}/{DOCUMENTS}-{uuid.uuid4().hex}"]]
    _put(_document_rows(docs, doc), path, doc)
    store.Manifest(docs.sparkSession, folder).commit({"parts": parts, "tombstones": {}, "next": 1, "doc": [doc, docs.schema[doc].dataType.simpleString()]})
    return Index(docs.sparkSession, folder)


def _document_rows(docs: DataFrame, doc: str) -> DataFrame:
    has = lambda c, k: F.col(c).cast(k) if c in docs.columns else F.lit(None).cast(k)
    boost = search.boost(F.col("path"), F.col("parsed")) if {"path", "parsed"} <= set(docs.columns) else F.lit(1)
    return docs.where(F.col(doc).isNotNull()).select(doc, *(has(c, "string").alias(c) for c in ("path", "name", "mime")), has("parsed", "boolean").alias("parsed"), boost.cast("int").alias("boost"))


def log_search(docs: DataFrame, line: str, doc: str = "doc_id", text: str = "content") -> DataFrame:
    """SR7, SR9, SR20 without a stored index: spans of all matches of a log line."""
    terms = search.log_query(line)
    hits = content_terms(docs, doc, text).where(F.col("term").isin(*(terms or [""])))
    return spans(search.without_overlaps(search.proximity_all(hits, terms, doc), doc), hits, line_table(docs, doc, text), doc)


class Index:
    """Queries over a stored index as its last manifest has it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.manifest = store.Manifest(spark, folder)
        self.state = self.manifest.current()
        self.doc, kind = self.state["doc"]
        self.kinds = {
            POSTINGS: f"{self.doc} {kind}, term string, position int, start int, end int", TERMS: "term string, docs long, hits long",
            GRAMS: "gram string, term string", EDGES: "length int, key string, prefix string",
            LINES: f"{self.doc} {kind}, line int, start int, next int, text string", DOCUMENTS: f"{self.doc} {kind}, path string, name string, mime string, parsed boolean, boost int",
        }

    # reading

    def _read(self, part: str, table: str) -> DataFrame:
        """A part's rows without those that tombstones void."""
        out = []
        for n, path in self.state["parts"].get(part, []):
            if part in (LINES, DOCUMENTS):
                rows = self.spark.read.schema(self.kinds[table]).parquet(path)
            else:
                at = f"{path}/{table}/{FIELD}={part}" if table == POSTINGS else _dictionary(self.spark, path, table, part, self.doc)
                rows = self.spark.read.schema(self.kinds[table]).parquet(at)
            void = [gone for upto, gone in self.state["tombstones"].get(part, []) if upto >= n]
            if void and table in (POSTINGS, LINES, DOCUMENTS):
                rows = rows.join(self.spark.read.schema(self.kinds[table].split(",")[0]).parquet(*void).distinct(), self.doc, "left_anti")
            out.append(rows)
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], self.kinds[table])

    def of(self, field: str, *terms: str) -> DataFrame:
        """Postings of a field, of some terms: doc, term, position, start, end."""
        p = self._read(field, POSTINGS)
        return p.where(F.col("term").isin(*terms)) if terms else p

    @property
    def documents(self) -> DataFrame:
        return self._read(DOCUMENTS, DOCUMENTS)

    @property
    def lines(self) -> DataFrame:
        return self._read(LINES, LINES)

    # terms

    def _by_grams(self, pieces: list[str], field: str) -> DataFrame:
        """Terms that hold all grams of the pieces; without any, all terms."""
        need = required_grams(pieces)
        if not need:
            return self._read(field, TERMS).select("term").distinct()
        found = self._read(field, GRAMS).where(F.col("gram").isin(*need)).groupBy("term").agg(F.countDistinct("gram").alias("n"))
        return found.where(F.col("n") == len(need)).select("term")

    def wildcard_terms(self, pattern: str, field: str = "content") -> DataFrame:
        """SR4: terms that match a pattern of ? and *, also leading."""
        p = pattern.lower()
        return self._by_grams(wildcard_pieces(p), field).where(F.col("term").like(search.like_pattern(p)))

    def regex_terms(self, pattern: str, field: str = "content") -> DataFrame:
        """SR5: terms that a pattern matches as a whole."""
        return self._by_grams(regex_pieces(pattern), field).where(F.col("term").rlike(f"^(?:{pattern})$"))

    def _starting(self, wanted: DataFrame, length: int, field: str) -> DataFrame:
        """Terms whose first characters are one of the prefixes wanted."""
        terms, some = self._read(field, TERMS).select("term").distinct(), [r[0] for r in wanted.limit(SENT + 1).collect()]
        if len(some) > SENT:
            return terms.join(wanted, F.expr(f"substring(term, 1, {length})") == F.col("prefix"), "left_semi")
        return terms.where(reduce(Column.__or__, (F.startswith("term", F.lit(p)) if len(p) == length else F.col("term") == p for p in some), F.lit(False)))

    def near_prefixes(self, start: str, edits: int, field: str) -> tuple[DataFrame, int]:
        """Prefixes within some edits of a string's, and their length (shorter ones are whole terms)."""
        if not 0 <= edits <= EDITS:
            raise ValueError(f"at most {EDITS} edits")
        length = min(PREFIX, max(1, len(start)))
        edges = self._read(field, EDGES).where(F.col("key").isin(*_deleted(start[:length], edits)) & (F.col("length") == length))
        return edges.select("prefix").distinct(), length

    def fuzzy_terms(self, term: str, edits: int = 2, field: str = "content") -> DataFrame:
        """SR5: terms within an edit distance of at most EDITS."""
        edges = self._read(field, EDGES).where(F.col("key").isin(*_deleted(term[:PREFIX], edits)) & (F.col("length") == PREFIX)).select("prefix").distinct()
        return self._starting(edges, PREFIX, field).where(F.levenshtein(F.col("term"), F.lit(term), edits) >= 0)

    def range_terms(self, low: str, high: str, field: str = "content") -> DataFrame:
        """SR5."""
        return self._read(field, TERMS).where(F.col("term").between(low, high)).select("term").distinct()

    def prefix_terms(self, start: str, field: str = "content") -> DataFrame:
        """SR5."""
        return self._read(field, TERMS).where(F.startswith("term", F.lit(start))).select("term").distinct()

    def of_terms(self, terms: DataFrame, field: str = "content") -> DataFrame:
        """Postings of the terms of a table: by a filter if they are few, else joined."""
        some = [r[0] for r in terms.limit(SENT + 1).collect()]
        if not some:
            return self.of(field).limit(0)
        return self.of(field, *some) if len(some) <= SENT else self.of(field).join(terms, "term", "left_semi")

    def hits(self, terms: DataFrame, field: str = "content") -> DataFrame:
        """Documents with any of the terms, and their hits."""
        return self.of_terms(terms, field).groupBy(self.doc).agg(F.count("*").alias("hits"))

    def suggest(self, typed: str, edits: int = 1, limit: int = 5, field: str = "name") -> DataFrame:
        """SR17: terms whose beginning is within some edits of what was typed, the nearest first."""
        t = typed.lower()
        prefixes, length = self.near_prefixes(t, edits, field)
        d = F.levenshtein(F.substring("term", 1, len(t)), F.lit(t))
        return self._starting(prefixes, length, field).select(F.col("term").alias("name"), d.alias("distance")).where(F.col("distance") <= edits).orderBy("distance", "name").limit(limit)

    # searches

    def any_of(self, terms: list[str], field: str = "content") -> DataFrame:
        """SR1: documents with any of the terms."""
        return search.any_of(self.of(field, *terms), terms, self.doc)

    def boolean(self, must: list[str], must_not: list[str] = (), should: list[str] = (), field: str = "content") -> DataFrame:
        """SR2."""
        return search.boolean(self.of(field, *must, *must_not, *should), must, must_not, should, self.doc)

    def phrase(self, terms: list[str], field: str = "content") -> DataFrame:
        """SR3."""
        return search.phrase(self.of(field, *terms), terms, self.doc)

    def proximity_all(self, terms: list[str], **options) -> DataFrame:
        """SR8: all matches of each document."""
        return search.proximity_all(self.of("content", *terms), terms, self.doc, **options)

    def proximity(self, terms: list[str], **options) -> DataFrame:
        """SR8: the best match of each document."""
        return search.proximity(self.of("content", *terms), terms, self.doc, **options)

    def line_matches(self, terms: list[str] | DataFrame, analysed: int | None = None) -> DataFrame:
        """SR10: runs of matching tokens on a line, with character columns."""
        hits = self.of_terms(terms) if isinstance(terms, DataFrame) else self.of("content", *terms)
        return line_runs(hits, self.lines, self.doc, analysed)

    def log_search(self, line: str) -> DataFrame:
        """SR7, SR9, SR20: all matches of a log line without those that contain another, as (line, column) spans."""
        terms = search.log_query(line)
        hits = self.of("content", *(terms or [""]))
        found = search.without_overlaps(search.proximity_all(hits, terms, self.doc), self.doc)
        return spans(found, hits, self.lines, self.doc)

    def ranked(self, terms: list[str], field: str = "content", limit: int = search.HIT_LIMIT) -> DataFrame:
        """SR13, SR19, SO7: the best documents by TF-IDF times boost."""
        scored = search.relevance(self.of(field, *terms), terms, self.documents.count(), self.doc)
        boosted = scored.join(self.documents.select(self.doc, "boost"), self.doc).withColumn("score", F.col("score") * F.col("boost")).drop("boost")
        return search.top(boosted, 0, limit, self.doc)

    def matches(self, text: list[str] | DataFrame | None = None, definitions: DataFrame | None = None, log: str | None = None) -> DataFrame:
        """SR11: line matches of each matcher that a search asks for, together: doc, start_line, start_col, end_line,
        end_col.  definitions: doc, line, name of tags (SR6), found as words on their line.  Documents without any match
        are in none of them and so drop out."""
        out = []
        if text is not None:
            m = self.line_matches(text)
            out.append(m.select(self.doc, F.col("line").alias("start_line"), "start_col", F.col("line").alias("end_line"), "end_col"))
        if definitions is not None:
            places = self.lines.join(definitions.select(self.doc, "line", "name"), [self.doc, "line"])
            rows = places.withColumn("start_col", F.instr(F.lower("text"), F.lower("name"))).where("start_col > 0")
            out.append(rows.select(self.doc, F.col("line").alias("start_line"), "start_col", F.col("line").alias("end_line"), (F.col("start_col") + F.length("name")).alias("end_col")))
        if log is not None:
            out.append(self.log_search(log).select(self.doc, F.col("first_line").alias("start_line"), F.col("first_col").alias("start_col"), F.col("last_line").alias("end_line"), F.col("last_col").alias("end_col")))
        if not out:
            raise ValueError("a search needs text, definitions or a log line")
        return reduce(DataFrame.unionByName, out).distinct()

    # changes

    def _commit(self, change) -> Index:
        self.state = state = self.manifest.current()
        change(state)
        self.manifest.commit(state)
        return Index(self.spark, self.folder)

    def _void(self, state: dict, part: str, docs: DataFrame, upto: int) -> None:
        """Documents' rows of a part are dead in segments up to one."""
        path = f"{self.folder}/tombstones-{uuid.uuid4().hex}"
        docs.select(self.doc).distinct().write.parquet(path)
        state["tombstones"].setdefault(part, []).append([upto, path])

    def set_fields(self, values: DataFrame) -> Index:
        """SRC19: new values of some fields of some documents (doc, and path, name, dir, mime, content or definition).

        Writes a segment of each field given and voids the documents' older postings of it; nothing else is touched."""

        def change(state):
            n = state["next"]
            for part, path in _write_segment(values, self.folder, self.doc).items():
                self._void(state, part, values, n - 1)
                state["parts"].setdefault(part, []).append([n, path])
            state["next"] = n + 1

        return self._commit(change)

    def set_documents(self, docs: DataFrame) -> Index:
        """SRC19: new document rows (path, name, mime, parsed; boost follows)."""

        def change(state):
            n, path = state["next"], f"{self.folder}/{DOCUMENTS}-{uuid.uuid4().hex}"
            _put(_document_rows(docs, self.doc), path, self.doc)
            self._void(state, DOCUMENTS, docs, n - 1)
            state["parts"][DOCUMENTS].append([n, path])
            state["next"] = n + 1

        return self._commit(change)

    def add(self, docs: DataFrame) -> Index:
        """SRC16: documents that are new, or whose every field is to be replaced."""
        return self.set_documents(docs).set_fields(docs)

    def remove(self, docs: DataFrame) -> Index:
        """Documents that are gone."""

        def change(state):
            for part in state["parts"]:
                self._void(state, part, docs, state["next"] - 1)

        return self._commit(change)

    def merge(self) -> Index:
        """Rewrites the parts that have tombstones as one segment each; the others' files stay as they are.  Readers of
        the old version go on until `vacuum`."""

        def change(state):
            old = {part: self._read(part, part if part in (LINES, DOCUMENTS) else POSTINGS) for part in state["tombstones"]}
            for part in old:
                path = f"{self.folder}/{part}-{uuid.uuid4().hex}"
                if part in (LINES, DOCUMENTS):
                    _put(old[part], path, *([self.doc, "line"] if part == LINES else [self.doc]))
                else:
                    _write_field(old[part], path, part, self.doc)
                state["parts"][part] = [[state["next"], path]]
            state["tombstones"] = {}
            state["next"] += 1

        return self._commit(change)

    def vacuum(self) -> None:
        """Deletes what the current manifest doesn't name."""
        state = self.manifest.current()
        live = {(part, path.rsplit("/", 1)[-1]) for part, segments in state["parts"].items() for _, path in segments}
        named = {name for _, name in live} | {path.rsplit("/", 1)[-1] for dead in state["tombstones"].values() for _, path in dead} | {"_manifest"}
        for name in store.listed(self.spark, self.folder):
            if name not in named:
                store.delete(self.spark, f"{self.folder}/{name}")
                continue
            for table in (POSTINGS, TERMS, GRAMS, EDGES):
                for field in store.listed(self.spark, f"{self.folder}/{name}/{table}"):
                    if field.startswith(f"{FIELD}=") and (field.split("=", 1)[1], name) not in live:
                        store.delete(self.spark, f"{self.folder}/{name}/{table}/{field}")
