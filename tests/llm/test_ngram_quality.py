"""Quality rules against brute force, and the Kneser-Ney model against one written out."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from srclake.llm import ngram_quality as nq

SCHEMA = "doc_id long, text string, lang string"


def brute_counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit |= set(range(i, i + 5))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(t.encode())]


def brute_model(texts, order):
    """Probability of a gram by modified Kneser-Ney, straight from the definition."""
    counts = {order: Counter()}
    for t in texts:
        b = b"\n" * (order - 1) + t.encode()
        counts[order].update(b[i : i + order] for i in range(len(b) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {k: nq.discounts([sum(v == i for v in c.values()) for i in range(1, 5)]) for k, c in counts.items()}
    by = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            by[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        row = by[k].get(g[:-1])
        if not row:
            return p(g[1:])
        d = lambda n: cut[k][min(n, 3) - 1] if n else 0
        n = counts[k].get(g, 0)
        return (n - d(n)) / sum(row) + sum(map(d, row)) / sum(row) * p(g[1:])

    return p


def texts(n, seed=3):
    rng = random.Random(seed)
    pool = ["the", "The", "of", "x#", "a&&", "ünï", "日本", "|", "line", "word", "tea", "\n", "\n", "same old line\n", "same old line\n", "\t", "\x0b"]
    return [None, "", " \n\t ", "one", "five words are just here", "a b c d e a b c d e", *(" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 80))) for _ in range(n))]


def test_counts(spark):
    rows = texts(60)
    for most in (64, 1 << 20):
        nq._bytes.groups.__defaults__ = (most,)
        try:
            import pyarrow as pa

            assert nq._counts(pa.array(rows, pa.string())).tolist() == [brute_counts(t) for t in rows]
        finally:
            nq._bytes.groups.__defaults__ = (nq._bytes.GROUP_BYTES,)


def test_discounts():
    assert nq.discounts([100, 30, 10, 5]) == pytest.approx([100 / 160, 2 - 3 * (100 / 160) * 10 / 30, 3 - 4 * (100 / 160) * 5 / 10])
    assert nq.discounts([0, 3, 2, 1]) == nq.discounts([4, 0, 2, 1]) == [0.5, 1.0, 1.5]


def test_model_matches_the_definition(spark):
    rows = [t for t in texts(25) if t]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], SCHEMA)
    model = nq.train(df)
    p = brute_model(rows, nq.ORDER)
    pack = lambda b: int.from_bytes(b, "big")
    got = {r["gram"]: r["p"] for r in model.own().collect()}
    seen = {(b"\n" * 4 + t.encode())[i : i + 5] for t in rows for i in range(len(t.encode()))}
    assert set(got) == {pack(g) for g in seen}
    for g in seen:
        assert got[pack(g)] == pytest.approx(p(g), rel=1e-12)
    new = [b"zzzzz", b"the q", b"ne on", b"\n\n\n\nQ", b"same ", b"xx of"]
    found = {r["gram"]: r["p"] for r in model.of(spark.createDataFrame([(pack(g),) for g in new], "gram long")).collect()}
    for g in new:
        assert found[pack(g)] == pytest.approx(p(g), rel=1e-12)
    # the probabilities after a context sum to one
    for context in (b"the ", b"same", b"qqqq"):
        every = spark.createDataFrame([(pack(context + bytes([i])),) for i in range(256)], "gram long")
        assert model.of(every).agg(F.sum("p")).first()[0] == pytest.approx(1)


def result(df):
    return sorted((tuple(r) for r in nq.judged(df).collect()), key=repr)


def test_rules(spark, monkeypatch):
    rng = random.Random(5)
    pool = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    clean = [" ".join(rng.choice(pool) + str(rng.randrange(9)) for _ in range(rng.randrange(60, 200))) for _ in range(60)]
    noise = "".join(chr(rng.randrange(33, 127)) + " " * (i % 7 == 0) for i in range(900))
    rows = [*texts(10), *clean, noise]
    data = [(i, t, ["en", "de", None][i % 3] if t != noise else "en") for i, t in enumerate(rows)]
    data += [data[20], data[20], (None, clean[3], "en")]
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(7) for c in ("gram", "n", "bits", "log2p", "_k1", "low", "q1", "n_words", "kept", "bin")})
    want = result(df.repartition(1))
    by = {r[0]: r for r in want if r[0] is not None}
    p = brute_model([t or "" for _, t, _ in data], nq.ORDER)
    for i, t, lang in data[: len(rows)]:
        n_words, chars, symbols, lines, repeats, size = brute_counts(t)
        r = by[i]
        assert r[1:6] == (n_words, chars, symbols, lines, repeats)
        failed = n_words < 10 or 100 * repeats > 20 * n_words
        assert (r[6], r[8]) == (failed, lang)
        if size:
            b = b"\n" * 4 + t.encode()
            assert r[9] == pytest.approx(-sum(math.log2(p(b[k : k + 5])) for k in range(size)) / size, abs=1e-5)
            assert r[10] == pytest.approx(2 ** r[9])
            assert r[7] == (not failed and r[11] <= r[9] <= r[12])
        else:
            assert r[7] is False and r[9] is None
    assert not by[len(rows) - 1][7] and all(by[i][7] or by[i][6] for i in range(16, 76))
    assert len(want) == len(data)
    assert result(df.repartition(7)) == want  # no matter how the rows are dealt
    monkeypatch.setattr(nq, "SLICE", 300)
    assert result(df.repartition(3)) == want  # nor how many slices the model has
    monkeypatch.setattr(nq, "BLOCK", 50)
    assert result(df.repartition(2)) == want


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nq.judged(empty).collect() == []
    nothing = spark.createDataFrame([(1, None, None), (2, "", "en"), (None, " ", "en")], SCHEMA)
    assert sorted((r["n_words"], r["base_failed"], r["kept"]) for r in nq.judged(nothing).collect()) == [(0, True, False)] * 3
    long = "very long text with some words, " * 60_000
    r = nq.judged(spark.createDataFrame([(1, long, "en")], SCHEMA)).first()
    assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (360_000, 360_000, True)
