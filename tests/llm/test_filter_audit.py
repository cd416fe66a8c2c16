"""The audit against every document's fate in every order; hot texts; awkward rows."""

import itertools
import re

from awkward import AWKWARD
from loglens.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, n string"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    """rows: (doc, text, lang)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    items = []
    for d, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
             "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        items.append((lang or "", {x for x in f if f[x]}, d in good, d in toxic))
    out = []
    for part in {i[0] for i in items}:
        mine, shap = [i[1:] for i in items if i[0] == part], dict.fromkeys("ABCDE", 0)
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [i for i in left if x in i[0]]
                left = [i for i in left if x not in i[0]]
                shap[x] += len(gone)
                fails = [i for i in mine if x in i[0]]
                lines.append((x, (part, "".join(order), step, len(left), len(gone), len(fails) - len(gone),
                                  sum(i[0] == {x} for i in mine), sum(i[1] for i in gone), sum(i[2] for i in gone))))
        out += [(*line, shap[x]) for x, line in lines]
    return sorted(out)


def run(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, p, 1, "x", "y") for d, t, p in rows],
                                 "doc_id long, text string, lang string, n int, fails string, digest string").repartition(4)
    got = filter_audit.audit(docs, spark.createDataFrame([(*x, "z") for x in labels], LABELS))
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


def test_every_order(spark):
    prose = " ".join(f"w{i}" for i in range(250))
    few = "one two three"
    rows = [(1, prose, "en"), (2, prose, "en"), (3, few, "en"), (4, few, None), (5, "a " * 300, "de"), (6, prose + " A#", "de"),
            (7, prose.upper(), "de"), (8, "A B " * 150 + "%", "en"), (9, "A B " * 150 + "%", "en"), (10, "", "en"), (11, None, "en")]
    labels = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (3, 1, 0), (8, None, 1), (9, 1, None), (None, 1, 1), (77, 1, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_awkward_rows(spark):
    rows = [(d, t, None if i % 2 else "en") for i, (d, t) in enumerate(AWKWARD)]
    rows += [(905, "same text twice", "en"), (None, "same text twice", "en"), (None, None, None), (1, "same text twice", "fr")]
    labels = [(905, 1, 0), (900, 0, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_hot_text(spark):
    """A third of the rows are one text: its copies come over the broadcast side."""
    rows = [(i, "the same" if i % 3 == 0 else f"text {i % 1000}", "en") for i in range(3000)]
    assert run(spark, rows, []) == brute(rows, [])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(docs, spark.createDataFrame([], LABELS)).collect() == []
    assert len(run(spark, [(1, "x", "en")], [])) == 600
