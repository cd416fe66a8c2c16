import hashlib
import random
from collections import Counter

import brute
from awkward import AWKWARD
from loglens.llm import line_dedup as L


def lines(seed, n=120):
    rnd = random.Random(seed)
    pool = [f"shared line number {i} " + "x" * rnd.randrange(5, 60) for i in range(40)]
    rows = []
    for d in range(n):
        text = [rnd.choice(pool) if rnd.random() < 0.5 else f"own {d} {i} " + "y" * 50 for i in range(rnd.randrange(1, 12))]
        text = [rnd.choice([str, str.upper, "  {}\t".format])(t) for t in text]
        rows.append((d, "\n".join(["A line of boilerplate that very many documents hold" if rnd.random() < 0.7 else "z", *text])))
    return rows


def check(got, rows):
    want = [(d, a, b, hashlib.sha256(t.encode()).hexdigest()) for d, a, b, t in brute.line_dedup(rows)]
    have = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got]
    assert Counter(have) == Counter(want)


def test_equals_brute_force_over_many_partitions(spark, docs):
    rows = lines(1) + AWKWARD
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "8", "60"):         # 60: hot lines run over many partition edges
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            check(L.deduplicated(docs(rows)).collect(), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_ids_that_repeat_are_one_document(docs):
    rows = [(1, f"a line that is long enough to count for all {i}\nthe very same line in each of the documents here") for i in range(9)]
    rows += [(d, "the very same line in each of the documents here") for d in (2, 3)]
    check(L.deduplicated(docs(rows)).collect(), rows)
    rows += [(d, "the very same line in each of the documents here") for d in (4, 5, None)]
    check(L.deduplicated(docs(rows)).collect(), rows)


def test_bitmaps_only_for_documents_that_lose_lines(docs):
    rows = [(d, "one line that is shared by all of these documents\nown") for d in range(6)] + [(50, "clean"), (51, None)]
    got = {r.doc: r for r in L.keep_bitmaps(docs(rows)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert L.kept_lines(rows[0][1], got[0].keep_bits) == (2, 1, "own")


def test_empty_table_and_other_columns(docs):
    got = L.deduplicated(docs([]))
    assert got.collect() == [] and got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
