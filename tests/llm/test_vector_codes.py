"""Vector codes against a plain Lloyd's algorithm on Python integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from srclake.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    ok = [(i, [math.floor(4096 * x) for x in np.array(v, np.float32).astype(float)], lab) for i, v, lab in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    if not ok:
        return []
    seeds = {}
    for i, v, _ in ok:
        seeds[i] = min(seeds.get(i, v), v)
    seeds = [seeds[i] for i in sorted(seeds)[:entries]]
    dim = len(seeds[0])
    seeds = [v for v in seeds if len(v) == dim]
    ok = [r for r in ok if len(r[1]) == dim]
    at = [p * dim // parts for p in range(parts + 1)]
    cut = lambda v, p: v[at[p] : at[p + 1]]
    books = [[cut(v, p) for v in seeds] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    code = lambda v: [min(range(len(b)), key=lambda k: (dist(cut(v, p), b[k]), k)) for p, b in enumerate(books)]
    for _ in range(rounds):
        sets = [defaultdict(list) for _ in books]
        for _, v, _ in ok:
            for p, k in enumerate(code(v)):
                sets[p][k].append(cut(v, p))
        books = [[[sum(c) // len(s[k]) for c in zip(*s[k], strict=True)] if k in s else e for k, e in enumerate(b)] for b, s in zip(books, sets, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = [(i, c := code(v), min(sum(dist(cut(v, p), books[p][k]) for p, k in enumerate(c)), vc.MOST), lab) for i, v, lab in ok]
    by = defaultdict(int)
    for *_, e, lab in out:
        by[lab] += e
    return sorted((i, "".join(f"{k:02x}" for k in c), e, min(by[lab], vc.MOST), digest) for i, c, e, lab in out)


def query(spark, rows, tmp_path, name):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(3) for c in ("id", "x", "code", "error", "sums", "kind", "_s")})
    df.repartition(5).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    return sorted(tuple(r) for r in vc.op12_vector_codes(spark, f"{tmp_path}/{name}").collect())


def vectors(n, dim, seed, grid):
    """Few distinct values, so that many distances tie."""
    rng = random.Random(seed)
    return [(i, [rng.randrange(-grid, grid) / 4096 for _ in range(dim)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("dim, grid, n", [(16, 3, 400), (13, 5, 150), (8, 2000, 300), (5, 4, 60), (64, 1000, 100)])
def test_equals_brute_force(spark, tmp_path, dim, grid, n):
    rows = vectors(n, dim, dim + grid, grid)
    rows += [(i, v, 1) for i, v, _ in rows[:40]] + [(1000, [0.5] * dim, 2)] * 150  # repeated ids and rows
    rows += [(None, [0.0] * dim, 1), (-5, None, 1), (-6, [], 1), (-7, [math.nan] * dim, 1), (-8, [math.inf] + [0.0] * (dim - 1), 1), (-9, [None] + [0.0] * (dim - 1), 1), (7000, [1.0] * (dim + 1), 1)]
    assert query(spark, rows, tmp_path, "a") == brute(rows)


def test_edges(spark, tmp_path, monkeypatch):
    assert query(spark, [], tmp_path, "empty") == []
    assert query(spark, [(1, None, 1)], tmp_path, "none") == []
    few = vectors(5, 16, 1, 50)
    assert query(spark, few, tmp_path, "few") == brute(few)
    # beyond 64 bits: products in whole numbers of any size, results cut to 64 bits
    big = [(i, [x * 1e9 if i % 3 else x for x in v], lab) for i, v, lab in vectors(60, 16, 2, 4000)]
    assert query(spark, big, tmp_path, "big") == brute(big)
    far = [(0, [0.0] * 8, 1), (1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [3e38] * 8, None)]
    got = query(spark, far, tmp_path, "far")
    assert [g[0] for g in got] == [0, 1, 2, 3] and all(g[2] == 0 for g in got)
    monkeypatch.setattr(vc, "FEW_LABELS", 1)
    rows = vectors(80, 16, 3, 5)
    assert query(spark, rows, tmp_path, "salted") == brute(rows)


def test_bounds_spare_scans():
    """Clustered vectors: after the first rounds few parts are compared with every entry, and codes stay exact."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (16, 32))
    x = (centres[rng.integers(0, 16, 3000)] + rng.integers(-200, 200, (3000, 32))).astype(np.int64)
    at = vc.cuts(32)
    books = vc.Books([x[:16, a:b].copy() for a, b in zip(at, at[1:], strict=False)])
    code, upper, lower = np.full((3000, 8), -1), np.zeros((3000, 8)), np.zeros((3000, 8))
    scans = []
    for _ in range(8):
        scans.append(vc.assign(x, books, code, upper, lower))
        for p, e in enumerate(books.entries):
            d = ((x[:, None, at[p] : at[p + 1]] - e[None]) ** 2).sum(axis=2)
            assert (code[:, p] == d.argmin(axis=1)).all()
            two = np.sqrt(np.sort(d, axis=1)[:, :2])
            assert (upper[:, p] >= two[:, 0]).all() and (lower[:, p] <= two[:, 1]).all()
        new = []
        for p, e in enumerate(books.entries):
            new.append(np.stack([x[code[:, p] == k, at[p] : at[p + 1]].sum(axis=0) // max(1, (code[:, p] == k).sum()) if (code[:, p] == k).any() else e[k] for k in range(len(e))]))
        books = vc.Books(new, books)
    assert scans[0] == 24_000 and scans[-1] < 6_000
