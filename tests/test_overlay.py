"""Blame carried over to working texts."""

import random

import pytest

from srclake.operators import history


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        up, row = row, [0]
        for j, y in enumerate(b):
            row.append(up[j] + 1 if x == y else max(up[j + 1], row[-1]))
    return row[-1]


@pytest.mark.parametrize("kinds", [2, 5, 1000])
def test_common_lines(kinds):
    rng = random.Random(kinds)
    for _ in range(120):
        a, b = ([str(rng.randrange(kinds)) for _ in range(rng.randrange(30))] for _ in range(2))
        b = b if rng.random() < 0.5 else [x for x in a if rng.random() < 0.7] + b[:3]
        got = history.common_lines(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False)) and len(got) == longest(a, b)


def test_overlay(spark):
    old = "one\ntwo\nthree\nfour\nfive"
    new = "zero\none\n2\nfour\nfive\nthree\nsix"  # added, edited, moved
    texts = lambda *rows: spark.createDataFrame(list(rows), "path string, content string")
    blame = spark.createDataFrame([("a", i, "AABBA"[i - 1]) for i in range(1, 6)], "path string, line int, commit_oid string")
    got = history.overlaid(blame, texts(("a", old), ("gone", "x"), ("b", "x\ny")), texts(("a", new), ("new", "n"), ("void", None), (None, "x"), ("b", "y\nx\ny")))
    u = history.UNCOMMITTED
    by = {(r["path"], r["line"]): (r["commit_oid"], r["orig_line"]) for r in got.collect()}
    assert [by["a", i] for i in range(1, 8)] == [(u, None), ("A", 1), (u, None), ("B", 4), ("A", 5), (u, None), (u, None)]
    assert by["new", 1] == (u, None) and {k for k in by if k[0] in ("void", None, "gone")} == set()
    assert [by["b", i][1] for i in (1, 2, 3)] == [None, 1, 2]
    hunks = {(r["first_line"], r["n_lines"], r["commit_oid"]) for r in history.blame_hunks(got.where("path = 'a'")).collect()}
    assert hunks == {(1, 1, u), (2, 1, "A"), (3, 1, u), (4, 1, "B"), (5, 1, "A"), (6, 2, u)}
