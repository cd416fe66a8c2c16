import random
from collections import Counter

import regex

import brute
from awkward import AWKWARD
from loglens.llm import license_scan as S


def base_hits(text):
    w, out = brute.words(text), []
    for phrase, label in S.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return len(w), out


def fuzzy_labels(text):
    """Every notice matched over the whole text, without seeds."""
    norm = " " + " ".join(brute.words(text)) + " "
    return {n.label for n in map(lambda x: S.notice(*x), S.NOTICES)
            if regex.search(r"(?<= )(?:%s){e<=%d}(?= )" % (n.phrase, n.edits), norm)}


def texts(seed, n=250):
    rnd = random.Random(seed)
    filler = "der licence mit by cc public general apachen lizenz lisense work under the".split()
    rows = []
    for d in range(n):
        w = [rnd.choice(filler) for _ in range(rnd.randrange(0, 30))]
        for _ in range(rnd.randrange(0, 3)):
            p = list(rnd.choice(S.NOTICES)[0])
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                i = rnd.randrange(len(p))
                p[i:i + 1] = rnd.choice([[], ["x"], [p[i], "e"], [p[i].upper()]])
            w.insert(rnd.randrange(len(w) + 1), "".join(p))
        rows.append((d, rnd.choice([" ", "-", "\n"]).join(w)))
    return rows


def test_base_and_labels_equal_brute_force(docs):
    rows = texts(1) + AWKWARD + [(950, "CC-BY cc by CC BY"), (951, "É apache license")]
    got = S.scan(docs(rows), keep=["doc_id"]).collect()
    want = Counter()
    for d, t in rows:
        n, hits = base_hits(t)
        at = [i for i, _ in hits]
        base = {x for _, x in hits}
        want[(d, n, len(hits), min(at, default=None), max(at, default=None), tuple(sorted(base)),
              tuple(sorted(base | fuzzy_labels(t))))] += 1
    have = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base_labels), tuple(r.labels)) for r in got)
    assert have == want
    assert all((r.score == 1.0) >= (r.n_base > 0) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)


def test_spans_and_edits(docs):
    got = S.scan(docs([(1, "under the Apche License, v2, or GNU Generl Public Licence.")])).collect()[0]
    spans = {(s.label, s.first_word, s.n_words, s.edits) for s in got.spans}
    assert ("apache", 2, 2, 1) in spans and ("gpl", 6, 4, 2) in spans and got.n_base == 0


def test_neighbouring_notices_all_give_spans(docs):
    """A poorer match in front of a better one is no less a match."""
    rows = [(1, "GNU General Public Licence GNU General Public License"), (2, "MIT licens MIT licence MIT license"),
            (3, "mit license, mit licens, mit license, mit licence"), (4, "gnu general public licence x gnu generl public licence gnu general public license")]
    got = {r.doc_id: [(s.label, s.first_word, s.n_words, s.edits) for s in r.spans] for r in S.scan(docs(rows)).collect()}
    assert got[1] == [("gpl", 0, 4, 1), ("gpl", 4, 4, 0)]
    assert got[2] == [("mit", 0, 2, 1), ("mit", 2, 2, 1), ("mit", 4, 2, 0)]
    assert got[3] == [("mit", 0, 2, 0), ("mit", 2, 2, 1), ("mit", 4, 2, 0), ("mit", 6, 2, 1)]
    assert got[4] == [("gpl", 0, 4, 1), ("gpl", 5, 4, 2), ("gpl", 9, 4, 0)]


def test_empty_table(docs):
    assert S.scan(docs([])).collect() == []


def test_megabytes_of_notices_take_seconds(docs):
    """The work grows with the notices, not with their square."""
    import time
    scanner = S.Scanner(S.BASE, S.NOTICES)
    took = []
    for n in (2_000, 8_000):
        t = time.process_time()
        got = S.scan_text(scanner, b"mit licens " * n + b"x")
        took.append(time.process_time() - t)
        assert sum(s["label"] == "mit" for s in got["spans"]) == n
    assert took[1] < 12 * took[0] + 1
    rows = [(1, "mit licens mit licence mit license " * 30_000), (2, "apache licence " * 70_000)]
    t = time.time()
    got = {r.doc_id: r for r in S.scan(docs(rows), keep=["doc_id"]).collect()}
    assert time.time() - t < 90 and len(got[1].spans) >= 90_000 and got[1].n_base == 30_000 and len(got[2].spans) >= 70_000


def test_columns_that_clash_are_made_anew(docs):
    r = S.scan(docs([(1, "MIT License"), (None, None)])).collect()
    assert {(x.doc_id, x.n_words, tuple(x.labels), x.h1) for x in r} == {(1, 2, ("mit",), "x"), (None, 0, (), "x")}
