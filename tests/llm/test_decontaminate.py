import random
from collections import Counter

import brute
from awkward import AWKWARD
from loglens.llm import decontaminate as D


def data(seed):
    rnd = random.Random(seed)
    vocab = [f"wö{i}" for i in range(40)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rnd.choice([1, 4, 9, 10, 11, 30])))) for i in range(12)]
    items += [(12, None), (13, "--"), (0, items[3][1]), (None, items[4][1])]
    rows = []
    for d in range(60):
        w = say(rnd.randrange(0, 60))
        if rnd.random() < 0.6:
            w += (rnd.choice(items)[1] or "").upper().split() + say(rnd.randrange(0, 20))
        rows.append((d, rnd.choice([" ", ", ", "\n"]).join(w)))
    return rows, items


def test_equals_brute_force(spark, docs):
    rows, items = data(1)
    rows = rows + AWKWARD
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((d, n, h, tuple(i)) for d, n, h, i in brute.decontaminate(rows, items))
    for table_bytes in (1 << 24, 4000):         # 4000: the windows take several passes, those of one item too
        got = D.annotate(docs(rows), bench, table_bytes=table_bytes).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == want


def test_spans_are_cut_from_the_text(spark, docs):
    item = "ä b c d e f g h i j k"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "é before, Ä-b c D e f g h i j k after"), (2, "ä b c d e f g h i"), (3, None)]
    got = {r.doc_id: r for r in D.decontaminated(docs(rows), bench, "spans").collect()}
    # Only A-Z are lowered: the capital Ä is not ä, so the window from b on is met.
    assert got[1].text == "é before, Ä- after"
    assert got[2].text == rows[1][1] and got[3].text is None
    left = D.decontaminated(docs(rows), bench).collect()
    assert {r.doc_id for r in left} == {2, 3} and {r.n_words for r in left} == {-1}     # the documents' own column


def test_one_long_item_is_dealt_to_many_blocks(spark, docs):
    rnd = random.Random(7)
    item = [rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(3000)]
    windows = D.stored(D.benchmark_windows(spark.createDataFrame([(1, " ".join(item)), (1, "x  Y"), (2, "x-y")],
                                                                 "item_id long, text string"), "item_id", "text", 10))
    want = {("1", " ".join(item[i:i + 10]).encode()) for i in range(2991)} | {("1", b"x y"), ("2", b"x y")}
    assert {(r.item, bytes(r.window)) for r in windows.collect()} == want and windows.count() == len(want)
    blocks = D.window_blocks(windows, 40_000)
    sizes = [sum(len(r.window) + len(r.item) + 40 for r in b.collect()) for b in blocks]
    assert len(blocks) > 5 and max(sizes) <= 40_000
    assert sum(len(keys) for b in blocks for keys, *_ in D._window_table(b.toArrow()).values()) == len(want)


def test_equal_hashes_are_told_apart_by_words(spark, docs, monkeypatch):
    """All windows of one length share a hash: only equal words count."""
    monkeypatch.setattr(D, "window_hashes", lambda h, n: D.np.zeros(max(0, len(h) - n + 1), D.np.uint64))
    rows, items = [(1, "a b"), (2, "b a"), (3, "c d"), (4, "a b c d")], [(7, "a b"), (8, "c d"), (9, "a b")]
    table = D._window_table(D.pa.table({"size": [2] * 3, "hash": D.pa.array([0] * 3, D.pa.int64()), "item": [str(i) for i, _ in items],
                                        "window": [t.encode() for _, t in items]}))

    class Shared:
        value = table
    kernel = D._kernel_maker(Shared)()
    data = D.np.frombuffer("".join(t for _, t in rows).encode(), D.np.uint8)
    got = kernel(data, D.np.cumsum([0] + [len(t) for _, t in rows]), None)
    assert got["item_ids"] == [["7", "9"], [], ["8"], ["7", "8", "9"]] and list(got["n_hit"]) == [2, 0, 2, 4]


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in D.annotate(docs([(1, "a b")]), bench).collect()] == [0]
    assert D.annotate(docs([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []
