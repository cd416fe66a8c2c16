"""Fingerprints against the hash library bit by bit; components against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from awkward import AWKWARD
from brute import SPACED, words
from hypothesis import given, settings
from hypothesis import strategies as st
from loglens.llm import simhash


def fingerprint(text, k=4):
    w = words(text, SPACED)
    runs = [w[i:i + k] for i in range(len(w) - k + 1)] if len(w) >= k else [w] if w else []
    h = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits=4):
    """Root index of every fingerprint, by all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def brute(rows, bits=4):
    fps = [fingerprint(t) for _, t in rows]
    root = components(fps, bits)
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, root)]


def key(r):
    return tuple((x is None, x) for x in r)


def run(df, **kw):
    return sorted((tuple(r) for r in simhash.near_duplicate_groups(df, **kw).collect()), key=key)


def texts(n, seed=5):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 3, 4, 30, 120]))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = "Changed"
        out.append((i, rng.choice([" ", "\t\n", "\x0b"]).join(w)))
    return out


def test_fingerprints_and_groups(docs):
    rows = texts(300) + [(1000, "One  two\tTHREE four"), (1001, "one two three four"), (1002, "É é"), (1003, "é é")]
    want = sorted(brute(rows), key=key)
    assert run(docs(rows)) == want
    assert len({r[2] for r in want}) < len(rows)


def test_awkward_rows(docs):
    rows = AWKWARD + [(None, "word " * 60_000), (None, "alone without an id"), (7, "alone without an id ")]
    assert run(docs(rows)) == sorted(brute(rows), key=key)


def test_empty_table(docs, spark):
    df = spark.createDataFrame([], "doc_id long, text string, fp long, rep long, n long")
    got = simhash.near_duplicate_groups(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.collect() == []


def planted(n, seed):
    """Fingerprints with chains of few differing bits, dense families and strangers."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for f in out[:n // 3]:
        for _ in range(3):
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 4, 5])):
                f ^= 1 << b
            out.append(f)
    family = rng.getrandbits(64)
    out += [family ^ 1 << a ^ 1 << b for a in range(0, 64, 3) for b in range(a)]
    return sorted(set(out))


@pytest.mark.parametrize("short, tile", [(32, 2048), (2, 2048), (2, 16), (4, 8)])
def test_links_by_every_path(spark, monkeypatch, short, tile):
    """Lists by shifts, cells by a matrix, cells cut into parts: the same components."""
    monkeypatch.setattr(simhash, "SHORT", short)
    monkeypatch.setattr(simhash, "TILE", tile)
    fps = planted(300, short + tile)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from loglens.llm.components import connected_components
    got = connected_components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(4)))
    of = dict(got.collect())
    groups, want = {}, {}
    for f, s, r in zip(fps, signed, components(fps)):
        groups.setdefault(of.get(s, s), set()).add(f)
        want.setdefault(r, set()).add(f)
    assert {frozenset(x) for x in groups.values()} == {frozenset(x) for x in want.values()}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4))
def test_near_fingerprints_share_a_cell(f, flips):
    g = f
    for b in flips:
        g ^= 1 << b
    cell, step, fp = simhash.grid_rows(np.array([f, g], np.uint64))
    mine = {(c, s) for c, s, x in zip(cell.tolist(), step.tolist(), fp.tolist()) if x == f}
    theirs = {(c, s) for c, s, x in zip(cell.tolist(), step.tolist(), fp.tolist()) if x == g}
    assert f == g or any(a == b and (s != t or s == 0) for a, s in mine for b, t in theirs)
