import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from awkward import AWKWARD
from loglens.llm import language_id as L

WORDS = {"en": "the of and to in that was with for his this have from they which".split(),
         "de": "der die und das nicht von sich mit dem für ist ein auch über schön".split(),
         "fr": "le la les des une est que pour dans qui sur avec être très où".split(),
         "ru": "и в не на что он как это по но они мы все так его".split()}


def texts(seed, n=200):
    rnd = random.Random(seed)
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        yield i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randrange(5, 80))), lang


def trained(spark):
    rows = list(texts(1)) + [(1000, "no language", None), (1001, None, "en")]
    return L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))


def test_held_out_texts_and_awkward_rows(spark, docs):
    model = trained(spark)
    assert model["langs"] == ["de", "en", "fr", "ru"]
    held = list(texts(2))
    got = {r.doc_id: r for r in L.labelled(docs([(i, t) for i, t, _ in held]), model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.99
    rows = L.labelled(docs(AWKWARD), model).collect()
    assert len(rows) == len(AWKWARD)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {900, 901, 902, 906} and all(r.score == 0 and r.spans == [] for r in rows if r.doc_id in und)
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_text_has_a_span_for_each_language(spark):
    model = trained(spark)
    text = "the house of that was with this; " * 4 + "Это не так что они, " * 4 + "der und das nicht schön. " * 4
    got = L.label_texts([text], model)
    spans = got["spans"][0]
    assert [s["lang"] for s in spans] == ["en", "ru", "de"]
    assert text[spans[1]["start"]:spans[1]["end"]].startswith("Это") and 0.3 < got["score"][0] < 0.5


def test_no_labels(spark, docs):
    model = L.train(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in L.labelled(docs([(1, "the text")]), model).collect()] == ["und"]
    assert L.labelled(docs([]), model).collect() == []


def test_one_language_and_its_script(spark, docs):
    model = L.train(spark.createDataFrame([(1, "ab cd", "aa")], "doc_id long, text string, lang string"))
    assert [(r.lang_pred, r.score) for r in L.labelled(docs([(1, "zz 字")]), model).collect()] == [("aa", 1.0)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 3), st.integers(0, 10_000))
def test_viterbi_equals_all_paths(n, k, seed):
    rnd = np.random.default_rng(seed)
    counts = [n, 0, max(1, n - 2)]
    first = np.concatenate([[0], np.cumsum(counts)])
    e = rnd.integers(-9, 9, (first[-1], k)).astype(np.float32)
    path = L.viterbi(e, first, 4.0)

    def value(p, part):
        return sum(part[i, x] for i, x in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:]))
    for a, b in zip(first[:-1], first[1:]):
        part = e[a:b]
        best = max(value(p, part) for p in itertools.product(range(k), repeat=b - a))
        assert value(path[a:b].tolist(), part) == best


def test_texts_without_a_letter_are_undetermined(spark, docs):
    """Marks alone, private use and tags are no letters, in any plane; marks within words are kept."""
    model = trained(spark)
    none = ["\u0301\u0301", "\U000F0000", "\U000E0041\U000E0042", "1 \u0301 2 \u20dd", "\U0001F600", "\u0301 " * 5000]
    some = ["\u0301 the of and", "\U00020000\U00030001", "e\u0301t\u0301 le la", "नमस्ते दुनिया"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.labelled(docs(list(enumerate(none + some))), model).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(len(none)))
    assert all(got[i][0] != "und" for i in range(len(none), len(none + some)))
    w = L.Letters(["\u0301 a\u0301b", "", "\u0301", "c"])
    assert w.first.tolist() == [0, 1, 1, 1, 2] and (w.end - w.start).tolist() == [3, 1]
