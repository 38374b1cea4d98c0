"""The conversation trie against one built from tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from srclake.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - (abs(c) % 100) * (1 if c > 0 else -1), [])[:h] + ts[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                kids[tuple(ts[: d - 1])].add(tuple(ts[:d]))
        ends[tuple(ts)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]) if p in kids else 0, leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items())


def query(spark, rows, tmp_path, name, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(3) for c in ("items", "node", "first", "depth", "_base", "t")})
    df.repartition(parts).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    return sorted((tuple(r) for r in pt.op13_prefix_trie(spark, f"{tmp_path}/{name}").collect()), key=lambda r: r[:2])


def talks(n, seed, most=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-350, 900), n):
        for t in range(rng.randrange(1, most)):
            rows.append((c, t if t or rng.random() < 0.8 else None, rng.choice(["user", "assistant", None, "u:1"]), rng.choice(["a", "b", "", None, "ünï 日本", "x" * 50])))
    return rows


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    rows = talks(300, 1)
    rows += [(None, 0, "user", "no conversation"), (None, None, None, None)]
    for c in range(2000, 2700):  # one conversation many times, and its extensions
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "answer")] + [(c, t, "user", f"more {c % 3}") for t in range(2, 2 + c % 4)]
    rows += [(5000, 0, "user", "very long " * 20_000)] + [(5001, t, "user", str(t % 7)) for t in range(120)]
    want = brute(rows)
    assert query(spark, rows, tmp_path, "a") == want
    monkeypatch.setattr(pt, "PIECE", 60)
    monkeypatch.setattr(pt, "HEAVY", 3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert query(spark, rows, tmp_path, "b", 11) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_edges(spark, tmp_path):
    assert query(spark, [], tmp_path, "empty") == []
    assert query(spark, [(None, 1, "user", "x")], tmp_path, "none") == []
    rows = [(c, 0, None, None) for c in range(100, 130)]  # one turn each: some conversations are rebuilt without any
    got = query(spark, rows, tmp_path, "short")
    assert got == brute(rows)
    twice = [(1, 0, "user", "a")] * 3 + [(2, None, "user", "z"), (2, 0, "user", "a")]
    assert query(spark, twice, tmp_path, "twice") == brute(twice)


def test_preorder(spark):
    rows = talks(120, 7)
    got = {r["node"]: r for r in pt.trie(pt.turns(spark.createDataFrame(rows, SCHEMA))).collect()}
    by_rank = sorted(got.values(), key=lambda r: r["preorder"])
    assert [r["preorder"] for r in by_rank] == list(range(len(got)))
    for r in by_rank:
        inside = set()
        for x in by_rank:
            y = x
            while y is not None:
                if y["node"] == r["node"]:
                    inside.add(x["preorder"])
                y = got.get(y["parent"])
        assert inside == set(range(r["preorder"], r["subtree_end"]))


def test_walk_streams():
    walk = pt.Walk()
    a, b = "a" * pt.DIGEST, "b" * pt.DIGEST
    for at, (c, key) in enumerate([(4, ""), (7, a), (9, a), (3, a + b), (5, b)]):
        walk.add(at, c, key, [1] * (len(key) // pt.DIGEST))
    walk.close(-1)
    assert sorted((n[2:9]) for n in walk.nodes) == [(0, 0, 4, 3, 5, 0, True), (1, 1, 3, 3, 3, 1, True), (1, 4, 4, 5, 1, 1, False), (2, 3, 3, 3, 1, 1, False)]
    assert sorted(e[2] for e in walk.ends) == ["3", "4", "5", "7,9"]


def test_equal_turns_have_an_order(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "c")]
    got = [pt.turns(spark.createDataFrame(r, SCHEMA)).first()["items"] for r in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 3


@pytest.mark.parametrize("role, text", [("a", "1:b"), ("a1:", "b"), ("", "a1:b")])
def test_role_and_text_are_apart(spark, role, text):
    both = pt.turns(spark.createDataFrame([(1, 0, role, text), (2, 0, "a", "1:b" if (role, text) != ("a", "1:b") else "1:c")], SCHEMA)).collect()
    assert both[0]["items"][0]["digest"] != both[1]["items"][0]["digest"]
