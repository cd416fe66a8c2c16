import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from awkward import AWKWARD
from loglens.llm import jaccard_join as J
from loglens.llm.components import connected_components


def near_copies(seed, groups=10):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" for i in range(60)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 20, 60, 150]))]
        for _ in range(rnd.choice([1, 3, 8, 90])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab).upper()
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    return rows


def check(got, rows):
    comp, sizes = brute.jaccard_components(rows)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter(sizes)
    wrong = [r for r in got if r.component_id != comp.get(r.doc_id)]
    assert not wrong


def test_components_equal_all_pairs(docs):
    rows = near_copies(1) + AWKWARD
    # An id that repeats with texts of two groups joins them.
    rows += [(2003, rows[0][1]), (2003, rows[5][1])]
    check(J.near_duplicate_groups(docs(rows)).collect(), rows)


def test_long_lists_and_cut_blocks(docs, monkeypatch):
    """A list of more than LIST texts becomes a block; a block beyond TILE is cut into parts."""
    monkeypatch.setattr(J, "LIST", 4)
    monkeypatch.setattr(J, "TILE", 3000)
    monkeypatch.setattr(J, "SIGNATURES", 2000)
    rows = near_copies(2, 8)
    check(J.near_duplicate_groups(docs(rows)).collect(), rows)


def test_crowded_cells_only_change_the_order(docs, monkeypatch):
    monkeypatch.setattr(J, "_crowded", lambda summary, bits, total: (np.arange(1 << bits) % 3).astype(np.uint8))
    rows = near_copies(3, 8)
    check(J.near_duplicate_groups(docs(rows)).collect(), rows)


def test_components_of_edges_that_differ_each_time(spark):
    """A spanning forest may be another one when it is worked out again; the components are the same."""
    groups = spark.range(0, 400, 1, 8).selectExpr("id", "id div 40 AS g")

    def forest(tab):
        ids = tab["id"].to_pylist()
        centre = random.SystemRandom().choice(ids)
        others = [i for i in ids if i != centre]
        return pa.table({"a": pa.array([centre] * len(others), pa.int64()), "b": pa.array(others, pa.int64())})

    got = connected_components(groups.groupBy("g").applyInArrow(forest, "a bigint, b bigint")).collect()
    assert sorted((r.node, r.component) for r in got) == [(i, i // 40 * 40) for i in range(400)]


def test_tile_gives_one_forest_for_rows_in_any_order(spark):
    rnd = random.Random(5)
    base = list(range(100, 140))
    rows = [(i, 39, np.array(sorted(set(base) - {rnd.choice(base)}), np.uint64).tobytes()) for i in range(30)]
    blocks = spark.createDataFrame([(i, 0) for i in range(30)], "node long, component long")
    seen = set()
    for _ in range(3):
        rnd.shuffle(rows)
        table = spark.createDataFrame(rows, "doc long, n int, value binary").coalesce(1)
        links = J._tiled(table, blocks, "n", J.TILE, lambda ids, n, values, q, t: J.links_within(
            ids, [np.frombuffer(v, np.uint64) for v in values], q, t, 80))
        seen.add(tuple(sorted((r.a, r.b) for r in links.collect())))
    assert len(seen) == 1 and len(seen.pop()) == 29


def test_empty_table(docs):
    assert J.near_duplicate_groups(docs([]), "doc_id").collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=25), min_size=1, max_size=20), st.sampled_from([50, 80, 100]))
def test_prefix_tree_finds_every_link(sets, percent):
    seqs = [np.array(sorted(s), np.uint32) for s in sets]
    trie = J.Trie(seqs)
    for i, s in enumerate(sets):
        want = {j for j, t in enumerate(sets) if 100 * len(s & t) >= percent * len(s | t)}
        assert set(trie.linked(seqs[i], 31, percent)) == want


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 1 << 60), max_size=400), st.sets(st.integers(0, 1 << 60), max_size=40), st.sets(st.integers(0, 1 << 60), max_size=40))
def test_signatures_never_differ_more_than_the_sets(common, left, right):
    a, b = common | left, common | right
    values = np.array(sorted(a) + sorted(b), np.uint64)
    x, y = (np.frombuffer(s, np.uint64)[None] for s in J.signatures(values, np.array([0, len(a), len(a) + len(b)])))
    w = min(x.shape[1], y.shape[1])
    assert int(np.bitwise_count(J.folded(x, w) ^ J.folded(y, w)).sum()) <= len(a ^ b)


def test_rows_without_an_id(docs):
    """No node of their own: the component of an equal set, or null; they connect nothing."""
    a, far = " ".join(f"w{i}" for i in range(60)), "quite another text of more than five words"
    near = a + " tail"                                     # links with a
    between = a + " tail end"
    rows = [(7, a), (None, a), (None, far), (9, near), (None, between), (3, "one two three four five six"), (None, None), (4, None)]
    got = sorted((r.n_shingles, str(r.doc_id), str(r.component_id)) for r in J.near_duplicate_groups(docs(rows)).collect())
    assert got == sorted([(56, "7", "7"), (56, "None", "7"), (4, "None", "None"), (57, "9", "7"), (58, "None", "None"),
                          (2, "3", "3"), (0, "None", "None"), (0, "4", "4")])
