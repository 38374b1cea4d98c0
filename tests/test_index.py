"""The stored search index against plain Python, and its segments, tombstones and merges."""

import os
import random

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from srclake import store
from srclake.functions import expr
from srclake.operators import index, search
from srclake.plans import bindings

COLS = "doc_id long, content string, name string, path string, parsed boolean"
TEXTS = [
    "int main\nreturn main_x #include\n\n\tMain  main", "main", None, "", "\n\n", "ünï_1 日本 ünï\nlast line", " lead and trail \n",
    "error: disk full\nat disk, error 7", "a b a b\na", "x" * 600 + " main\nmain " + "y " * 400 + "main",
]


def tokens(text):
    return [(m.group().lower(), m.start(), m.end()) for m in regex.finditer(expr.TOKEN, text or "")]


def place(text, offset):
    line = text.count("\n", 0, offset) + 1
    return line, offset - (text.rfind("\n", 0, offset) + 1) + 1


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"F{i}.cc" if i % 2 else f"g{i}.txt", f"/src/d{i % 3}/f{i}." + ("cc" if i % 2 else "txt"), i < 3) for i, t in enumerate(TEXTS)] + [(None, "main", "n", "/n", True)], COLS)


@pytest.fixture(scope="module")
def ix(spark, docs, tmp_path_factory):
    return index.build(docs, str(tmp_path_factory.mktemp("ix") / "a"))


def test_offsets(ix):
    want = sorted((i, k, t, a, b) for i, text in enumerate(TEXTS) for k, (t, a, b) in enumerate(tokens(text)))
    assert rows(ix.of("content"), "doc_id", "position", "term", "start", "end") == want
    lines = [(i, n + 1, line) for i, t in enumerate(TEXTS) if t is not None for n, line in enumerate(t.split("\n"))]
    assert rows(ix.lines, "doc_id", "line", "text") == sorted(lines)


def brute_runs(terms, analysed=index.ANALYSED):
    out = []
    for i, text in enumerate(TEXTS):
        run = None
        for k, (t, a, b) in enumerate(tokens(text)):
            if t not in terms or a >= analysed:
                continue
            line, col = place(text, a)
            if run and run[0] == k - 1 and run[1] == line:
                run = [k, line, run[2], col + b - a, run[4] + 1]
                out[-1] = (i, *run[1:])
            else:
                run = [k, line, col, col + b - a, 1]
                out.append((i, *run[1:]))
    return sorted(out)


def test_line_matches(ix):
    cols = ["doc_id", "line", "start_col", "end_col", "tokens"]
    assert rows(ix.line_matches(["main", "int"]), *cols) == brute_runs({"main", "int"})
    assert rows(ix.line_matches(["a", "b"]), *cols) == brute_runs({"a", "b"})
    assert rows(ix.line_matches(["main"], 600), *cols) == brute_runs({"main"}, 600)
    assert rows(ix.line_matches(ix.wildcard_terms("?ain*")), *cols) == brute_runs({"main", "main_x"})


def test_spans(ix):
    got = ix.log_search("error in disk").collect()
    t = TEXTS[7]
    assert [(r["doc_id"], r["first_line"], r["first_col"], r["last_line"], r["last_col"]) for r in got if r["score"] == max(x["score"] for x in got)] == [(7, *place(t, 0), *place(t, 11))]
    assert ix.log_search("error").count() == 0
    for r in ix.log_search("A, b!").collect():
        assert TEXTS[r["doc_id"]].split("\n")[r["first_line"] - 1][r["first_col"] - 1] in "ab"


def test_log_terms_are_the_index_terms():
    assert search.log_query("_x a#b __init__ x") == ["_x", "a#b", "__init__", "x"]
    assert search.log_query("again and again") == ["again", "and", "again"]
    assert search.proximity_matches([[0, 9], [4], [0, 9]])[0][:2] == (0, 9)  # a repeated word takes two places


def test_string_ids(spark, tmp_path):
    d = spark.createDataFrame([("k1", "alpha x beta"), ("k2", "beta")], "key string, content string")
    s = index.build(d, str(tmp_path / "s"), "key")
    assert rows(s.proximity(["alpha", "beta"]), "key", "first", "last") == [("k1", 0, 2)]
    assert rows(s.line_matches(["beta"]), "key", "line", "start_col") == [("k1", 1, 9), ("k2", 1, 1)]


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    rng = random.Random(2)
    out = {"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12))) for _ in range(700)} | {"a.b", "a+b", "abcabcabc", "ünïcödé", "a|b", "x(y)"}
    d = spark.createDataFrame([(i, w) for i, w in enumerate(sorted(out))], "doc_id long, name string")
    return index.build(d, str(tmp_path_factory.mktemp("ix") / "w")), out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, up = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(up[j] + 1, row[-1] + 1, up[j - 1] + (x != y)))
    return row[-1]


def test_wildcards(words):
    w, every = words
    for p in ("abc*", "*bcd*", "?bc", "*", "a?c*e", "*de", "a.b", "A*B?", "abc", "*ünï*é", "????"):
        r = regex.compile(regex.escape(p.lower(), special_only=False).replace("\\*", ".*").replace("\\?", "."))
        assert {x[0] for x in w.wildcard_terms(p, "name").collect()} == {t for t in every if r.fullmatch(t)}, p


def test_regexes(words):
    w, every = words
    for p in ("abc.*", "a(b|c)d?e*", ".*bcd", "[ab]+", "abc|cba", "(abc)+", r"a\.b", r"a\+b", "abcd?", "ab{2}.*", "a.c.*", r"\S+", "(?:ab)c.*", r"[^a]bc[d\]].*", "(?i)ABC.*", "x[(]y[)]", "abc+d*", "ab(c(d|e))?"):
        assert {x[0] for x in w.regex_terms(p, "name").collect()} == {t for t in every if regex.fullmatch(p, t, flags=regex.V0)}, p
    assert index.regex_pieces("th(e|is)at") == ["\x02th", "at\x03"] and index.regex_pieces("abc|d") == [] and index.regex_pieces("ab+c?d") == ["\x02ab", "d\x03"]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_fuzzy_and_suggestions(words, edits):
    w, every = words
    for q in ("abc", "abcabca", "a", "edcbaedcba", "bbbbbbbbbbb", "ünicode", "cab"):
        assert {x[0] for x in w.fuzzy_terms(q, edits, "name").collect()} == {t for t in every if distance(t, q) <= edits}, q
        want = sorted((d, t) for t in every if (d := distance(t[: len(q)], q)) <= edits)[:20]
        assert [(r["distance"], r["name"]) for r in w.suggest(q, edits, 20, "name").collect()] == want, q


def test_few_row_groups_are_read(ix):
    pushed = lambda df, what: regex.search(r"PushedFilters: \[[^\n]*" + what, df._jdf.queryExecution().executedPlan().toString())
    assert pushed(ix.of("content", "main", "return"), r"In\(term, \[main,return\]\)")
    for df in (ix.phrase(["int", "main"]), ix.line_matches(["int", "main"]), ix.boolean(["int"], ["main"]), ix.proximity_all(["int", "main"]), ix.hits(ix.wildcard_terms("?ain*")), ix.hits(ix.fuzzy_terms("main", 2)), ix.log_search("int main")):
        assert pushed(df, r"(In|EqualTo)\(term,")
    assert pushed(ix.wildcard_terms("*main*"), r"In\(gram") and pushed(ix.regex_terms("main.*"), r"In\(gram")
    near, _ = ix.near_prefixes("main", 1, "content")
    assert pushed(near, r"In\(key")
    assert pushed(ix._starting(near.where("prefix = 'main'"), 4, "content"), r"StringStartsWith\(term,main\)")


def test_more_terms_than_a_filter_takes(words, monkeypatch):
    w, every = words
    want = rows(w.hits(w.wildcard_terms("a*", "name"), "name"), "doc_id", "hits")
    fuzzy = {x[0] for x in w.fuzzy_terms("abcd", 2, "name").collect()}
    monkeypatch.setattr(index, "SENT", 2)
    assert rows(w.hits(w.wildcard_terms("a*", "name"), "name"), "doc_id", "hits") == want and len(want) > 50
    assert {x[0] for x in w.fuzzy_terms("abcd", 2, "name").collect()} == fuzzy


def files_of(folder, part=""):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(folder) if f"/{part}" in d for f in fs if f.endswith(".parquet")}


def everything(ix):
    out = {f: rows(ix.of(f), "doc_id", "term", "position", "start", "end") if f == "content" else rows(ix.of(f), "doc_id", "term", "position") for f in ("content", "name", "path", "definition")}
    return out | {"lines": rows(ix.lines, "doc_id", "line", "start", "text"), "documents": rows(ix.documents.fillna(""), "doc_id", "path", "boost")}


def test_segments(spark, tmp_path):
    base = [(i, f"word{i % 7} common text {i}\nline", f"f{i}", f"/d/f{i}.cc", False, f"old{i % 3} kept") for i in range(200)]
    cols = COLS + ", definition string"
    d = spark.createDataFrame(base, cols)
    folder = str(tmp_path / "ix")
    ix = index.build(d, folder)
    before = files_of(folder)
    tags = spark.createDataFrame([(i, f"new{i} tag") for i in (5, 77)], "doc_id long, definition string")
    ix = ix.set_fields(tags)
    after = files_of(folder)
    assert {k: after[k] for k in before} == before  # 1 % of the documents: nothing that was there is written again
    assert all("/field=definition" in k or "/tombstones-" in k for k in set(after) - set(before))
    now = [(*r[:5], f"new{r[0]} tag" if r[0] in (5, 77) else r[5]) for r in base]
    whole = lambda rs, name: everything(index.build(spark.createDataFrame(rs, cols), str(tmp_path / name)))
    want = whole(now, "b")
    assert everything(ix) == want
    merged = ix.merge()
    assert everything(merged) == want and merged.state["tombstones"] == {}
    assert everything(ix) == want  # who reads the old version still can
    merged.vacuum()
    left = files_of(folder)
    assert everything(merged) == want and not any("/tombstones-" in k for k in left)
    assert {k: v for k, v in left.items() if "=definition" not in k} == {k: v for k, v in before.items() if "=definition" not in k}
    # a document again and again, one that is new, others gone, a parse status
    change = [(5, "other words", "n5", "/e/n5.cc", True, "newest"), (900, "brand new", "n900", "/e/n900.txt", True, None)]
    ix = merged.add(spark.createDataFrame([(5, "never seen", "z", "/z", False, "z")], cols)).add(spark.createDataFrame(change, cols))
    ix = ix.remove(spark.createDataFrame([(6,), (77,), (12345,)], "doc_id long"))
    ix = ix.set_documents(spark.createDataFrame([(8, "f8", "/d/f8.cc", True)], "doc_id long, name string, path string, parsed boolean"))
    now = [r if r[0] != 8 else (*r[:4], True, r[5]) for r in now if r[0] not in (5, 6, 77)] + change
    want = whole(now, "c")
    assert everything(ix) == want and everything(ix.merge()) == want
    ix.vacuum()
    assert rows(index.Index(spark, folder).any_of(["never"]), "doc_id") == [] and rows(index.Index(spark, folder).any_of(["brand"]), "doc_id") == [(900,)]


def test_a_run_that_stops_leaves_the_old_version(spark, docs, tmp_path, monkeypatch):
    folder = str(tmp_path / "ix")
    ix = index.build(docs, folder)
    want = rows(ix.of("content"), "doc_id", "term")

    def stop(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(index.Index, "_void", stop)
    with pytest.raises(RuntimeError):
        ix.set_fields(docs.select("doc_id", F.lit("other").alias("content")))
    monkeypatch.undo()
    assert rows(index.Index(spark, folder).of("content"), "doc_id", "term") == want
    # two writers that read the same state: the second fails
    a, b = store.Manifest(spark, folder), store.Manifest(spark, folder)
    one, two = a.current(), b.current()
    a.commit(one)
    with pytest.raises(Exception, match="exist"):
        b.commit(two)


def test_matchers(spark, ix):
    tags = spark.createDataFrame([(0, 1, "main"), (7, 2, "disk"), (7, 1, "absent")], "doc_id long, line int, name string")
    got = rows(ix.matches(["error"], tags, "disk full"), "doc_id", "start_line", "start_col", "end_line", "end_col")
    assert got == [(0, 1, 5, 1, 9), (7, 1, 1, 1, 6), (7, 1, 8, 1, 17), (7, 1, 13, 2, 8), (7, 2, 4, 2, 8), (7, 2, 10, 2, 15)]
    with pytest.raises(ValueError):
        ix.matches()


def test_empty(spark, tmp_path):
    ix = index.build(spark.createDataFrame([], COLS), str(tmp_path / "e"))
    assert ix.any_of(["x"]).collect() == [] and ix.line_matches(["x"]).collect() == [] and ix.hits(ix.fuzzy_terms("x")).collect() == []
    assert ix.suggest("x", field="name").collect() == [] and ix.ranked(["x"]).collect() == []


def test_dictionaries_are_made_when_asked_for(spark, tmp_path):
    """Line matches read postings only; a wildcard needs terms and grams, not the fuzzy terms' neighbourhoods."""
    folder = str(tmp_path / "ix")
    ix = index.build(spark.createDataFrame([(1, "of the sea"), (2, "mention_no of")], "doc_id long, content string"), folder)
    made = lambda: {t for t in (index.TERMS, index.GRAMS, index.EDGES) if any(f"/{t}/" in f for f in files_of(folder))}
    assert rows(ix.line_matches(["of", "the"]), "doc_id", "start_col", "tokens") == [(1, 1, 2), (2, 12, 1)] and made() == set()
    assert rows(ix.hits(ix.wildcard_terms("*tion?n*")), "doc_id", "hits") == [(2, 1)] and made() == {index.TERMS, index.GRAMS}
    assert rows(ix.fuzzy_terms("see", 1), "term") == [("sea",)] and made() == {index.TERMS, index.GRAMS, index.EDGES}


def test_whole_texts_are_matched(spark, tmp_path):
    """sr10_indexed: matches beyond a text's first 1,000 characters count, in the query and in its SQL."""
    long = "yy " * 200_000 + "\nthat is\n"
    spark.createDataFrame([(1, "y " * 800 + "the", "en", "web", 1603), (2, long, "en", "web", len(long))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = bindings.queries()["sr10_indexed"](spark, str(tmp_path))
    assert rows(got, "doc_id", "line", "start_col", "end_col", "tokens") == [(1, 1, 1601, 1604, 1), (2, 2, 1, 5, 1)]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert len(c.sql(bindings.oracle_sql()["sr10_indexed"]).fetchall()) == 2


def test_matchers_read_whole_texts(spark, tmp_path):
    """sr11_matchers: matches beyond 500 KiB count."""
    text = "yy " * 200_000 + "\nof\n"
    ix = index.build(spark.createDataFrame([(1, text)], "doc_id long, content string"), str(tmp_path / "ix"))
    assert rows(ix.matches(["of"]), "doc_id", "start_line", "start_col", "end_line", "end_col") == [(1, 2, 1, 2, 3)]
