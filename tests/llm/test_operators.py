"""Operators against brute force, and on nulls, empty, long, tied, repeated and clashing rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from srclake.llm import _bytes, chat, components, decontaminate, hmm_lm, language_id, license_scan, line_dedup, near_dedup, packing, quality, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the quick brown fox jumps over the lazy dog and then runs through the green forest with another animal"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann durch den grünen wald zurück"
RU = "быстрая коричневая лиса прыгает через ленивую собаку и бежит по лесу"


def docs(spark, rows):
    """(doc_id, text, lang) rows with the other columns and some whose names clash with the operators' own."""
    df = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], DOCS)
    return df.withColumns({c: F.lit(7) for c in ("row", "key", "score", "component_id", "words", "line", "id", "a", "b", "length", "gone", "n_removed", "lang_pred")})


def words_alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def words_space(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def mixed_texts(n, seed=1):
    rng = random.Random(seed)
    pool = ["alpha", "Beta", "γάμμα", "delta's", "x1", "É", "日本", "the", "of"]
    return [None, "", " \n\t ", "one", *(" ".join(rng.choice(pool) + rng.choice(["", ",", "!\n", "\x0b"]) for _ in range(rng.randrange(1, 60))) for _ in range(n))]


def test_words_and_ngrams():
    texts = mixed_texts(40)
    for mask, split in ((_bytes.ALNUM, words_alnum), (_bytes.NONSPACE, words_space)):
        for most in (1, 300, 1 << 20):
            got, grams = [], []
            for i, j, buf, st, en, first in _bytes.documents(pa.array(texts, pa.string()), mask, most):
                h = _bytes.word_hashes(buf, st, en)
                sh, of = _bytes.ngram_hashes(h, first, 4)
                for d in range(j - i):
                    got.append([bytes(_bytes.LOWER[buf[a:b]]).decode() for a, b in zip(st[first[d] : first[d + 1]], en[first[d] : first[d + 1]], strict=True)])
                    grams.append(len(sh[of[d] : of[d + 1]]))
            assert got == [split(t) for t in texts]
            assert grams == [max(len(w) - 3, min(len(w), 1)) for w in got]
    h = {}
    for *_, buf, st, en, _f in _bytes.documents(pa.array([" ".join(f"w{i}" for i in range(5000))]), _bytes.ALNUM):
        h = set(_bytes.word_hashes(buf, st, en).tolist())
    assert len(h) == 5000


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2060)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = components.components(spark.createDataFrame(links + links[:9], "a long, b long"))
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r["id"]: r["component"] for r in got.collect()} == {x: find(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1


def test_language_id(spark):
    d = docs(spark, [(i, " ".join(random.Random(i).sample(t.split(), 10)), lang) for i in range(30) for t, lang in ((EN, "en"), (DE, "de"), (RU, "ru"))])
    model = language_id.train(d)
    assert model["langs"] == ["de", "en", "ru"]
    test = docs(spark, [(1, EN, None), (2, DE, None), (3, RU, None), (4, f"{EN} {EN} {DE}", None), (5, None, None), (6, "", None), (7, "12 34 !!", None), (8, "你好", None), (None, EN, "x"), (1, EN, None), (9, EN * 3000, None)])
    out = language_id.predict(test, model, spans=True).collect()
    by = {r["doc_id"]: r for r in out}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == ["en", "de", "ru", "en", "und", "und", "und", by[8]["lang_pred"], "en"]
    assert by[8]["lang_pred"] in model["langs"] and by[8]["score"] <= language_id.FOREIGN
    assert [(s["lang"]) for s in by[4]["spans"]] == ["en", "de"] and by[4]["spans"][1]["n_words"] == len(DE.split())
    assert len(out) == 11 and all(0 <= r["score"] <= 1 for r in out) and by[5]["score"] == 0
    tie = language_id.train(docs(spark, [(1, "abc abc", "x"), (2, "abc abc", "w")]))
    assert [r["lang_pred"] for r in language_id.predict(docs(spark, [(1, "abc", None), (2, "\U00031000", None), (3, "\u4dc0 \U000f0000", None)]), tie).collect()] == ["w", "w", "und"]
    empty = language_id.train(d.limit(0))
    assert [r["lang_pred"] for r in language_id.predict(test.limit(2), empty).collect()] == ["und", "und"]
    assert language_id.predict(test.limit(0), model).count() == 0


def test_viterbi_shortcut():
    """Documents that skip the recursion have the recursion's labels."""
    rng = np.random.default_rng(5)
    first = np.array([0, 0, 7, 60, 61, 200])
    s = (rng.normal(size=(200, 4)) * 3 + np.repeat([[2, 0, 0, 0]], 200, axis=0)).astype(np.float32)
    s[100:150, 2] += 9
    got = language_id.label_words(s, first, 8.0)
    for a, b in zip(first, first[1:], strict=False):
        if b > a:
            best = {(): 0.0}
            path = language_id.viterbi(s[a:b], 8.0)
            value = lambda p, a=a: sum(s[a + i, x] for i, x in enumerate(p)) - 8.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))
            assert value(path) == pytest.approx(value(got[a:b]), abs=1e-3)
            if b - a <= 7:
                import itertools

                best = max(value(p) for p in itertools.product(range(4), repeat=int(b - a)))
                assert value(path) == pytest.approx(best, abs=1e-3)
    assert set(got[100:150]) == {2}


# --- 2


def brute_contamination(text, items, n=13):
    w = words_alnum(text)
    hit, found = set(), set()
    for ident, item in items:
        iw = words_alnum(item)
        m = min(n, len(iw))
        for k in range(len(iw) - m + 1 if iw else 0):
            for p in range(len(w) - m + 1):
                if w[p : p + m] == iw[k : k + m]:
                    hit.update(range(p, p + m))
                    found.add(str(ident))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, monkeypatch):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(6)]
    items = [(1, " ".join(rng.choice(vocab) for _ in range(20))), (2, "W1 w2"), (3, ""), (4, None), (2, "w3-w3 w3"), (10, "é É")]
    texts = [None, "", "w1", items[0][1].upper().replace(" ", ", "), "x " * 50 + items[0][1] + " y", "É é É"] + [" ".join(rng.choice(vocab) for _ in range(rng.randrange(60))) for _ in range(40)] + ["pad " * 40000 + items[0][1]]
    d = docs(spark, [*((i, t, "en") for i, t in enumerate(texts)), (None, texts[3], "en"), (3, texts[3], "en")])
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    for block in (1 << 20, 8):  # all items at once, and in blocks
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = decontaminate.contaminated(d, b).collect()
        assert len(got) == len(texts) + 2
        for r in got:
            n, hit, found = brute_contamination(texts[r["doc_id"] if r["doc_id"] is not None else 3], items)
            assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, found)
            assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    assert decontaminate.contaminated(d, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contaminated(d.limit(0), b).count() == 0


def test_benchmark_item_without_id(spark):
    item = " ".join(f"w{i}" for i in range(15))
    d = docs(spark, [(1, "a " + item, "en"), (2, "w1 w2", "en")])
    b = spark.createDataFrame([(None, item, 0)], "item_id long, text string, doc_id int")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {1: (16, 15, [], True), 2: (2, 0, [], False)}


def test_proximity(spark):
    d = docs(spark, [(1, "a x x b a b", None), (2, "a x x x b", None), (3, None, None)])
    got = decontaminate.near(decontaminate.build_index(d), ["a", "B"], 4).collect()
    assert sorted(map(tuple, got)) == [(1, 3, 4), (1, 4, 5)] or sorted(map(tuple, got)) == [(1, 0, 3), (1, 3, 4), (1, 4, 5)]


# --- 3


def brute_components(texts, n):
    sets = []
    for t in texts:
        w = words_space(t)
        sets.append({tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set())
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return [len(s) for s in sets], comp


def near_copies(seed=4, groups=12, each=7):
    rng = random.Random(seed)
    out = [None, "", "two words", "Two  words", "a b c d", " \n"]
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(spark, n):
    texts = near_copies()
    d = docs(spark, [(i, t, None) for i, t in enumerate(texts)])
    size, comp = brute_components(texts, n)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(d, n).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == size
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert [got[i]["kept"] for i in range(len(texts))] == [c == i for i, c in enumerate(comp)]


def test_near_duplicates_of_a_large_group(spark):
    """More near copies than a region holds, so that deeper levels and hubs are used."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(120):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(150)] = f"e{i}x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    got = near_dedup.near_duplicates(docs(spark, [(i, t, None) for i, t in enumerate(texts)]), 4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(brute_components(texts, 4)[1]))


def test_near_duplicates_of_one_template(spark, monkeypatch):
    """Documents that share most of a template, below the threshold (0.76) but for planted pairs just above it (0.801)."""
    monkeypatch.setattr(near_dedup, "REGION", 12)
    rng = random.Random(12)
    template = [f"t{i}" for i in range(260)]
    own = lambda: [f"o{rng.randrange(10**7)}" for _ in range(42)]
    texts = []
    for k in range(60):
        a = own()
        b = a[:12] + own()[:30] if k % 2 else own()
        texts += [" ".join(a + template), " ".join(b + template)]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    links = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 100 * len(a & b) >= 80 * len(a | b)]
    assert links == [(2 * k, 2 * k + 1) for k in range(1, 60, 2)]
    comp = [dict((j, i) for i, j in links).get(i, i) for i in range(len(texts))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, [(i, t, None) for i, t in enumerate(texts)]), 4).collect()}
    assert [got[i] for i in range(len(texts))] == comp


def test_prefix_join_is_exact(spark):
    rng = random.Random(5)
    texts = near_copies(seed=8, groups=4, each=12)
    for i in range(20):
        w = texts[20].split()
        for k in rng.sample(range(len(w)), rng.randrange(1, 5)):
            w[k] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t and t.split()], "id long, text string").cache()
    pairs = near_dedup.prefix_join(d.select("id", F.col("id").alias("component")), d, 4, 80)
    got = {(r["a"], r["b"]) for r in near_dedup.confirmed(pairs, d, 4, 80).collect()}
    sets = {r["id"]: {tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} for r in d.collect() for w in [words_space(r["text"])]}
    assert got == {(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and 100 * len(a & b) >= 80 * len(a | b)} and len(got) > 100


def test_near_duplicates_edges(spark):
    d = docs(spark, [(5, EN, None), (5, DE, None), (5, EN, None), (2, EN, None), (None, EN, None), (None, None, None)])
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(d).collect())
    assert got == Counter({(5, 2, False): 2, (5, 5, True): 1, (2, 2, True): 1, (None, 2, False): 1, (None, None, True): 1})
    assert near_dedup.near_duplicates(d.limit(0)).count() == 0


# --- 4


def test_isotonic():
    x, y = quality.isotonic([1, 2, 3, 4], [1, 1, 2, 1], [0, 1, 0, 1])
    assert list(y) == [0, 1 / 3, 1] and all(np.diff(x) > 0)


def test_quality(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(EN.split()) for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join(rng.choice(EN.split()).upper() + "!!" for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), None) for i in range(300)]
    d = docs(spark, [*rows, (900, None, None), (901, "", None), (902, "\x00 é" * 9999, None), (None, "x", None), (0, rows[0][1], None)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(1, None, None), (2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(d, labels, lambda c: F.col(c) % 2 == 0).collect()
    assert len(out) == 305 and all(0 <= r["score"] <= 1 for r in out)
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in out if r["doc_id"] is not None and r["doc_id"] < 300 and r["doc_id"] % 2]) > 0.97
    assert {r["score"] for r in quality.classify(d.limit(3), labels.limit(0), lambda c: F.lit(True)).collect()} == {0.5}
    assert quality.classify(d.limit(0), labels, lambda c: F.lit(True)).count() == 0


def test_normal_equations(spark):
    """The solution equals that of ridge regression on all rows at once, over many partitions."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, quality.N_STATS))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    train = spark.createDataFrame([(r.tolist(), float(v), i % quality.FOLDS) for i, (r, v) in enumerate(zip(x, y, strict=True))], "stats array<double>, label double, fold int").repartition(20)
    model = quality.fit(train)
    phi = quality.Kernel(x.mean(axis=0), x.std(axis=0))(x)
    a = phi.T @ phi + quality.RIDGE * len(x) * np.eye(phi.shape[1]) / phi.shape[1]
    assert np.allclose(model["weights"], np.linalg.solve(a, phi.T @ y), atol=1e-6)


# --- 5


def test_license_scan(spark):
    t = [None, "", "MIT License", "cc by cc-by, Apache\nLICENSE and MIT license", "xmit license", "Released under the MIT License.", "released under mit license terms",
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "a " * 30000 + "mit license"]
    d = docs(spark, [*((i, x, None) for i, x in enumerate(t)), (None, t[2], None), (2, t[2], None)])
    got = {r["doc_id"]: r for r in license_scan.scan(d).collect()}
    assert [(got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"]) for i in range(9)] == [(0, 0, None, None), (0, 0, None, None), (2, 1, 0, 0), (9, 4, 0, 7), (2, 0, None, None), (5, 1, 3, 3), (5, 1, 2, 2), (16, 0, None, None), (30002, 1, 30000, 30000)]
    assert got[5]["found"] == ["notice:mit"] and got[6]["found"] == ["notice:mit"] and got[7]["found"] == ["text:mit"] and got[2]["found"] == []
    assert license_scan.scan(d).count() == 11 and license_scan.scan(d.limit(0)).count() == 0


@pytest.mark.parametrize("lines", [1, 3])
def test_containment_join_is_exact(spark, lines):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(14)]
    templates = [(f"t{i}", " ".join(rng.sample(vocab, rng.randrange(2, 9)))) for i in range(6)]
    texts = ["\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 14))) for _ in range(4)) for _ in range(40)]
    got = {r["doc_id"]: set(r["found"]) for r in license_scan.scan(docs(spark, [(i, x, None) for i, x in enumerate(texts)]), templates, threshold=0.75, lines=lines).collect()}
    for i, x in enumerate(texts):
        blocks = [set(" ".join(x.split("\n")[k : k + lines]).split()) for k in range(4)]
        assert got[i] == {lab for lab, tm in templates if any(len(b & set(tm.split())) >= math.ceil(0.75 * len(set(tm.split()))) for b in blocks)}


def test_license_notices_wrapped_and_shared_ids(spark):
    wrapped = "Permission is hereby granted, free of charge,\nto any person obtaining a copy\nof this software"
    far = wrapped.replace("\n", "\n\n\n")
    d = docs(spark, [(1, wrapped, None), (1, "hello world", None), (None, "MIT\nLicense", None), (None, "plain", None), (2, far, None), (3, "wor\u212a mit license \u0130", None)])
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_base"], ",".join(r["found"])) for r in license_scan.scan(d).collect())
    assert got == [(0, 1, 0, ""), (0, 2, 1, ""), (1, 2, 0, ""), (1, 16, 0, "text:mit"), (2, 16, 0, ""), (3, 4, 1, "")]


def test_license_notices_wrapped_narrowly(spark):
    """However few words a line has, within a paragraph; the result is that of blocks made one by one."""
    mit = dict(license_scan.TEMPLATES)["text:mit"].split()
    rng = random.Random(5)
    texts = ["\n".join(f"// {' '.join(mit[i : i + k])}" for i in range(0, len(mit), k)) for k in (1, 2, 3, 5)]  # 18, 9, 6 and 4 lines
    texts += ["many words before it " * 30 + texts[0], texts[1].replace("\n", "\n\n"), texts[1].replace("\n", "\n//\n"), "\n\n" + texts[2] + "\n\nend", "x\n" * 500 + texts[0]]
    every = [w for _, t in license_scan.TEMPLATES for w in t.split()]
    for _ in range(60):
        texts.append("\n".join(" ".join(rng.choice(every) for _ in range(rng.choice((0, 1, 2, 8)))) for _ in range(rng.randrange(1, 40))))
    longest = max(len(t.split()) for _, t in license_scan.TEMPLATES)

    def blocks(text):
        ls = [re.findall("[a-z0-9]+", x.lower()) for x in text.split("\n")]
        for i in range(len(ls)):
            j = i + 1
            while j < len(ls) and ls[j] and sum(map(len, ls[i + 1 : j])) < longest:
                j += 1
            yield {w for x in ls[i : max(j, i + license_scan.LINES)] for w in x}

    got = {r["doc_id"]: set(r["found"]) for r in license_scan.scan(docs(spark, [(i, x, None) for i, x in enumerate(texts)])).collect()}
    for i, x in enumerate(texts):
        assert got[i] == {lab for lab, t in license_scan.TEMPLATES if any(len(b & set(t.split())) >= math.ceil(0.8 * len(set(t.split())) - 1e-9) for b in blocks(x))}
    assert all("text:mit" in got[i] for i in (0, 1, 2, 3, 4, 7, 8))
    assert not any("text:mit" in got[i] for i in (5, 6))


# --- 6


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_very_long_line(spark):
    x = " ".join(f"words{i}" for i in range(30))
    d = docs(spark, [(1, x, None), (2, x.upper(), None), (3, x.replace("words7 ", "other "), None)])
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(d).collect()} == {1: 0, 2: 1, 3: 1}


def test_simhash_and_confirmation(spark):
    rng = random.Random(6)
    lines = [" ".join(f"word{rng.randrange(10**6)}" for _ in range(150)) for _ in range(15)]
    edited = [x.replace(x.split()[70], "otherword", 1) for x in lines]
    d = docs(spark, [(i, x, None) for i, x in enumerate(lines + edited)])
    rows = d.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    table = {r["doc_id"]: r for r in line_dedup.line_table(rows).collect()}
    for i in (0, 20):
        words = spark.createDataFrame([(w,) for w in (lines + edited)[i].split()], "w string").select(F.xxhash64("w").alias("h")).distinct().collect()
        sample = sorted(r["h"] for r in words)[: line_dedup.SAMPLE]
        assert table[i]["sim"] == sum(1 << j for j in range(60) if sum((h >> j) & 1 for h in sample) > len(sample) // 2)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(d).collect()}
    assert all(got[15 + i] for i in range(15)) and not any(got[i] for i in range(15))
    x = [("a b c d", "a b c e"), ("aa b c d", "a b c d"), ("kitten on a mat", "sitting on the mat"), ("a b", "a b c"), ("x", "y"), ("same tail here", "other tail here")]
    pairs = spark.createDataFrame([(i, 100 + i, a, b) for i, (a, b) in enumerate(x)], "a long, b long, x string, y string")
    for least in (0.5, 0.7, 0.9):
        assert {r["a"] for r in line_dedup.confirmed(pairs, least).collect()} == {i for i, (a, b) in enumerate(x) if edit_distance(a, b) <= (1 - least) * max(len(a), len(b)) + 1e-9}


def test_line_dedup(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    d = docs(spark, [(3, "first line with words\nshort\n" + long, None), (1, "First line, with WORDS!\nshort", None), (2, None, None), (4, "", None), (5, long + "\n\nunique words stay here ok", None), (5, long + "\n\nunique words stay here ok", None), (None, "first line with words", None), (1, "another text of one", None)])
    got = line_dedup.dedup_lines(d)
    assert set(got.columns) >= set(d.columns) and got.count() == 8
    by = {(r["doc_id"], r["n_removed"], r["text"][:12] if r["text"] else r["text"]) for r in got.collect()}
    # the null id comes first; of equal texts under one id both rows keep or lose the same lines
    assert by == {(None, 0, "first line w"), (3, 1, "short\nw0 w1 "), (1, 1, "short"), (2, 0, None), (4, 0, ""), (5, 1, "\nunique word"), (1, 0, "another text")}
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def removed_by_brute_force(lines):
    """Lines that share a component with an earlier one, links by edit similarity."""
    parent = list(range(len(lines)))
    for j, b in enumerate(lines):
        for i, a in enumerate(lines[:j]):
            if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                parent = [parent[i] if p == parent[j] else p for p in parent]
    return {i for i, p in enumerate(parent) if p in parent[:i]}


def test_lines_at_the_threshold(spark):
    """Every sixth word put for another: further apart than few bits of a SimHash, within the similarity."""
    rng = random.Random(16)
    lines = [" ".join(f"word{rng.randrange(10**5):05}" for _ in range(n)) for n in (5, 6, 7, 8, 9, 10, 11, 12, 13, 20, 30, 60, 150)]
    edited = [" ".join(w if i % 6 != 2 else f"other{rng.randrange(10**4):04}" for i, w in enumerate(x.split())) for x in lines]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs(spark, [(i, x, None) for i, x in enumerate(lines + edited)])).collect()}
    want = removed_by_brute_force(lines + edited)
    assert {i for i in got if got[i]} == want and len(want) == len(lines) - 1  # of nine words, 18 of 89 letters differ


def test_large_buckets_of_lines(spark, monkeypatch):
    """One frequent run of words in all lines, and near copies of one line around the threshold."""
    monkeypatch.setattr(line_dedup, "BUCKET", 4)
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(10**4):04}"
    lines = ["the same first words " + " ".join(word() for _ in range(6)) for _ in range(30)]
    lines += [x[:-1] + "x" for x in lines[::3]]
    base = [word() for _ in range(12)]
    for _ in range(40):
        w = list(base)
        for i in rng.sample(range(12), rng.randrange(1, 4)):
            w[i] = word()
        lines.append(" ".join(w))
    rng.shuffle(lines)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs(spark, [(i, x, None) for i, x in enumerate(lines)])).collect()}
    assert {i for i in got if got[i]} == removed_by_brute_force(lines)


def test_lines_that_share_only_a_large_bucket(spark):
    """A run of words that 80 lines have is all that two similar lines share: no further key brings them together."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    lines = ["the same run " + " ".join(word() for _ in range(6)) for _ in range(80)]
    near = "the same run " + " ".join(word() for _ in range(6))
    lines += [near, " ".join(w if w in ("the", "same", "run") else w[:-1] + "0" for w in near.split())]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs(spark, [(i, x, None) for i, x in enumerate(lines)])).collect()}
    assert {i for i in got if got[i]} == removed_by_brute_force(lines) == {81}


def test_lines_with_changed_letters(spark):
    """A letter changed in half of the words: most of the two lines' different words are not common."""
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    lines = [" ".join(word() for _ in range(10)) for _ in range(20)]
    edited = [" ".join(w if i < 4 else w[:3] + "0" + w[4:] for i, w in enumerate(x.split())) for x in lines]
    texts = docs(spark, [(i, x, None) for i, x in enumerate(lines + edited)])
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(texts).collect()}
    assert {i for i in got if got[i]} == removed_by_brute_force(lines + edited) == set(range(20, 40))


def test_counts_of_letters_bound_the_edits(spark):
    rng = random.Random(20)
    lines = ["".join(rng.choice("eeentthaoirsx ") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, t string")
    got = {r["i"]: (r["low"], r["high"]) for r in d.select("i", *(line_dedup.counts(F.col("t"), m).alias(n) for n, m in zip(("low", "high"), line_dedup.LETTERS, strict=True))).collect()}
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            apart = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(got[i], got[j], strict=True))
            assert apart <= 2 * edit_distance(a, b) - abs(len(a) - len(b))


def test_long_lines_meet_by_three_simhashes(spark):
    """Long lines that have a third of their words in common: one SimHash of 60 bits lets many pairs through."""
    rng = random.Random(21)
    common = [f"common{i}" for i in range(12)]
    lines = []
    for _ in range(60):
        w = common + [f"word{rng.randrange(10**6)}" for _ in range(24)]
        rng.shuffle(w)
        lines.append(" ".join(w))
    lines += [x.replace(x.split()[5], "otherword", 1) for x in lines]
    d = docs(spark, [(i, x, None) for i, x in enumerate(lines)])
    table = line_dedup.line_table(d.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")).cache()
    key = {r["key"]: r["doc_id"] for r in table.collect()}
    end = F.struct(*line_dedup.MEMBER)
    pairs = table.select(end.alias("x")).crossJoin(table.select(end.alias("y"))).where("x.key < y.key")
    one = pairs.where(F.bit_count(F.col("x.sim").bitwiseXOR(F.col("y.sim"))) <= line_dedup.DISTANCE).count()
    met = {frozenset((key[r["a"]], key[r["b"]])) for r in line_dedup._fitting(pairs).collect()}
    assert {frozenset((i, 60 + i)) for i in range(60)} <= met and 2 * len(met) < one


def test_lines_of_any_length(spark):
    long = " ".join(f"w{i}" for i in range(33_000))
    han = "".join(chr(0x4E00 + i * 37) for i in range(40))
    lines = [long, long.replace("w500 ", "other "), han, han, han[:20] + "\u4e01" + han[21:], "two words", "two words"]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs(spark, [(i, x, None) for i, x in enumerate(lines)])).collect()}
    assert [got[i] for i in range(len(lines))] == [0, 1, 0, 1, 1, 0, 0]


# --- 7


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 100]) for i in range(300)] + [(300, None), (301, [float("nan")] * 6), (302, [None] * 6), (303, [float("inf")] + [0.0] * 5), (50, [0.01] * 6), (304, [1.0]), (None, [0.0] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    ok = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    got = {}
    for r in topk.top_k(v, v.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    for q in {i for i, _ in ok if i % 50 == 0}:
        want = []
        for i, e in ok:
            if i == q:
                hits = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), j) for j, f in ok if j != q and len(f) == len(e))[:5]
                want.append([(k + 1, j, -s) for k, (s, j) in enumerate(hits)])
        assert len(want) > 1 or sorted(got[q]) == want[0]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0
    twice = spark.createDataFrame([(0, [1.0]), (0, [-1.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<double>")
    for block in (1, 1 << 20):
        monkeypatch.setattr(topk, "BLOCK_COMPONENTS", block)
        both = sorted((r["rank"], r["id"], r["score"]) for r in topk.top_k(twice, twice.where("vec_id = 0")).collect())
        assert both == [(1, 1, -2 * 65536), (1, 2, 3 * 65536), (2, 1, 2 * 65536), (2, 2, -3 * 65536)]
    big = spark.createDataFrame([(0, [1e14, 1.0]), (1, [1e14, 2.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(big, big.where("vec_id = 0")).first()["score"] == (1 << 63) - 1
    few = v.where("vec_id < 3")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2


# --- 8


def test_packing(spark):
    path = packing.tokenizer_path()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    odd = [None, "", "don't it's I'LL x_y. a-b, (c). q! <|endoftext|> z", "É́ İ Σας 日本語, ok.", "<|ENDOFTEXT|> a.", "a b ŉ ǆ ſ²½,", "word " * 9000, EN, EN]
    rng = random.Random(3)
    texts = odd + [" ".join(rng.choice(EN.split()) + rng.choice(["", ".", "!!"]) for _ in range(rng.randrange(1, 900))) for _ in range(120)]
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in texts]
    d = docs(spark, [(i, x, None) for i, x in enumerate(texts)]).repartition(5)
    pieces = packing.packed(d).collect()
    seen = {}
    places = {}
    for r in pieces:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, x in enumerate(ids):
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == len(x)
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(map(len, ids)) / (4096 * len(places)) > 0.9
    assert packing.packed(d.limit(0)).count() == 0


def test_patterns():
    rng = random.Random(2)
    for _ in range(20):
        h = {rng.randrange(1, 65): rng.randrange(1, 50) for _ in range(rng.randrange(1, 40))}
        patterns = packing.shortest_pack_first(h, 64)
        got = Counter()
        for c, lengths in patterns:
            assert c > 0 and sum(lengths) <= 64
            for x in lengths:
                got[x] += c
        assert got == Counter(h)
        table = packing.slots(patterns)
        assert len(table["length"]) == sum(len(ls) for _, ls in patterns)


# --- 9


def test_chat_round_trip():
    rng = random.Random(7)
    codec = chat.Codec(chat.Template())
    bits = [*chat.Template().controls(), "\\", "\\\\", "x", " ", "\n", "[", "<", "/"]
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[ROLE]"]), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(5))]
        segs = codec.segments(turns)
        assert [(r, t) for r, t, _ in codec.read_back("".join(s for s, _ in segs))] == turns


def test_chat(spark):
    rows = [(1, 1, "assistant", "yes", 0), (1, 0, "user", "ok?", 0), (2, 0, "user", None, 0), (2, 0, None, "x", 0), (2, 0, None, "x", 0), (None, None, "assistant", "</s>", 0), (3, 0, "user", "a" * 200_000, 0)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    f = chat.format_chats(c)
    got = {r["conv_id"]: r for r in chat.digests(f).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\nok?\nassistant\nyes\n") and got[1]["loss_sha256"] == sha("yes") and got[1]["loss_chars"] == 3 and got[1]["valid"]
    assert got[2]["n_turns"] == 3 and not got[2]["valid"] and got[2]["turns_sha256"] == sha("\nx\n\nx\nuser\n\n")
    assert got[None]["loss_sha256"] == sha("</s>") and not got[None]["valid"] and got[3]["n_turns"] == 1
    assert chat.digests(chat.format_chats(c.limit(0))).count() == 0
    segs = {r["conv_id"]: r["segments"] for r in f.collect()}
    assert [s["text"] for s in segs[1] if s["loss"]] == ["yes"]


# --- 10


def test_hmm_matches_brute_force():
    rng = np.random.default_rng(3)
    hmm = hmm_lm.Hmm(*(x / x.sum(axis=a, keepdims=True) for x, a in ((rng.random(3), 0), (rng.random((3, 3)), 1), (rng.random((hmm_lm.SYMBOLS, 3)), 0))))
    sym = rng.integers(0, hmm_lm.SYMBOLS, 9).astype(np.uint16)
    first = np.array([0, 4, 5, 5, 9]) if False else np.array([0, 4, 5, 9])
    want, starts, moves = [], np.zeros(3), np.zeros((3, 3))
    import itertools

    for a, b in zip(first, first[1:], strict=False):
        total, s0, m0 = 0.0, np.zeros(3), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(b - a)):
            p = hmm.start[path[0]] * np.prod([hmm.emit[sym[a + i], k] for i, k in enumerate(path)]) * np.prod([hmm.move[x, y] for x, y in zip(path, path[1:], strict=False)])
            total += p
            s0[path[0]] += p
            for x, y in zip(path, path[1:], strict=False):
                m0[x, y] += p
        want.append(math.log10(total))
        starts += s0 / total
        moves += m0 / total
    assert hmm.forward(sym, first) == pytest.approx(want)
    s, m, e, ll = hmm.expected(sym, first)
    assert ll == pytest.approx(sum(want)) and s == pytest.approx(starts, abs=1e-5) and m == pytest.approx(moves, abs=1e-5) and e.sum() == pytest.approx(9, abs=1e-4)


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(hmm_lm, "RANGE_BYTES", 500)
    texts = mixed_texts(60) + [EN, EN, EN * 400]
    d = docs(spark, [*((i, t, None) for i, t in enumerate(texts)), (None, EN, None)]).repartition(3)
    held = F.col("doc_id") % 3 == 1
    got = hmm_lm.score(d, held).collect()
    assert len(got) == len(texts) + 1
    tok = [[*words_space(t), "\0end"] for t in texts]
    c = Counter(w for i, ws in enumerate(tok) if i % 3 != 1 for w in ws) + Counter([*words_space(EN), "\0end"])
    n, v = sum(c.values()), len(c)
    for r in got:
        ws = tok[r["doc_id"]] if r["doc_id"] is not None else [*words_space(EN), "\0end"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) and r["score"] < 0
        assert r["held_out"] == (r["doc_id"] is not None and r["doc_id"] % 3 == 1)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert len({(r["n_tokens"], r["score"]) for r in got if r["doc_id"] in (None, len(texts) - 3, len(texts) - 2)}) == 1  # repeated rows
    assert hmm_lm.score(d.limit(0), held).count() == 0
    assert {r["train_tokens"] for r in hmm_lm.score(d.limit(4), F.lit(True)).collect()} == {0}


def test_line_dedup_leaves_no_tables_or_shuffles(spark, monkeypatch):
    """when the last pairs are made, the lines' sketches and the pairs and texts of earlier rounds are gone, and
    storing a table leaves no shuffle files."""
    folder, seen, last = line_dedup._scratch.shared_dir(spark).removeprefix("file:"), [], line_dedup._all_pairs
    before = set(os.listdir(folder))
    monkeypatch.setattr(line_dedup, "_all_pairs", lambda m: (seen.extend(f.split("-")[1] for f in os.listdir(folder) if f.startswith("llm-") and f not in before), last(m))[1])
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[:30] + [f"x{i}"])) for i in range(4)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in line_dedup.dedup_lines(docs).collect()) == [0, 1, 1, 1]
    assert {"members", "at", "open"} <= set(seen) and not {"lines", "met", "pairs", "norms"} & set(seen)

    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    n = shuffles()
    line_dedup._scratch.saved(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "t")
    assert shuffles() <= n
