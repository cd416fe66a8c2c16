"""The treap against the plain grid; the search against exhaustive scores."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from awkward import AWKWARD
from brute import words
from loglens.llm import k2treap
from loglens.llm.k2treap import Treap


def brute(rows, items, k=50):
    terms = [(d, Counter(words(t))) for d, t in rows]
    some = [(d, c, c.total()) for d, c in terms if c]
    n_docs, n_terms = len(some), sum(n for _, _, n in some)
    df = Counter(t for _, c, _ in some for t in c)
    asked = {}
    for item, t in items:
        asked.setdefault(item, set()).update(words(t))
    out = []
    for item, query in asked.items():
        found = []
        for d, c, n in some:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in query if c[t])
            if s > 0:
                found.append((d, s))
        found.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, i, d, s) for i, (d, s) in enumerate(found[:k], 1)]
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def run(spark, df, items, **kw):
    got = k2treap.search(df, spark.createDataFrame(items, "item_id long, text string"), **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=key)


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocab = [f"t{i}" for i in range(400)]
    weight = [1 / (i + 1) for i in range(400)]
    return [(rng.randrange(10 * n), " ".join(rng.choices(vocab, weight, k=rng.choice([1, 5, 40, 200])))) for _ in range(n)]


@pytest.mark.parametrize("shape", [(1, 1), (3, 200), (500, 7), (64, 64), (900, 300)])
def test_tree_equals_grid(shape):
    rng = np.random.default_rng(shape[0])
    grid = np.where(rng.random(shape) < 0.2, rng.integers(1, 1000, shape), 0)
    grid[0, 0] = 5
    row, col = np.nonzero(grid)
    tree = Treap.build(row, col, grid[row, col])
    again = Treap.unpacked(tree.packed())
    assert (again.max == tree.max).all() and (again.keys == tree.keys).all() and (again.first == tree.first).all()
    for size in (1, 3, min(12, shape[0])):
        rows = rng.choice(shape[0], min(size, shape[0]), replace=False)
        weight = rng.integers(1, 9, len(rows))
        score = (grid[rows] * weight[:, None]).sum(0)
        for k, floor in ((5, 0), (50, 0), (3, int(np.sort(score)[-2:][0]))):
            cols, got = again.best(rows, weight, k, floor)
            want = sorted(((-s, c) for c, s in enumerate(score.tolist()) if s >= max(1, floor)))[:k]
            assert list(zip((-got).tolist(), cols.tolist())) == want


@pytest.mark.parametrize("points, block, at_once", [(1 << 21, 1 << 17, 64), (300, 40, 2)])
def test_search_equals_exhaustive(spark, docs, monkeypatch, points, block, at_once):
    for name, v in (("POINTS", points), ("BLOCK", block), ("AT_ONCE", at_once)):
        monkeypatch.setattr(k2treap, name, v)
    rows = corpus(600)
    rows += [(100_000 + i, rows[i % 7][1]) for i in range(200)]              # ties: many copies
    rng = random.Random(9)
    items = [(i, " ".join(f"T{rng.randrange(420)}" for _ in range(rng.choice([1, 3, 30])))) for i in range(25)] + [(99, "nowhere at all")]
    assert run(spark, docs(rows, 20), items) == sorted(brute(rows, items), key=key)


def test_awkward_rows(spark, docs):
    rows = AWKWARD + [(None, "same text twice"), (1, "text, Text! TEXT")]
    items = [(None, "text"), (1, None), (2, ""), (3, "word é"), (4, "same"), (4, "some id"), (None, "here")]
    assert run(spark, docs(rows), items) == sorted(brute(rows, items), key=key)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert run(spark, none, [(1, "a b")]) == []
    assert k2treap.search(docs([(1, "a b")]), spark.createDataFrame([], "item_id long, text string")).collect() == []
