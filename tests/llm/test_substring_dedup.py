import random
import re
import zlib
from collections import Counter

from awkward import AWKWARD
from brute import UP
from loglens.llm import substring_dedup as S


def cut(text):
    """The sentences of a text, cut by a walk over its characters: (text, key)."""
    text, out, held = text or "", [], ""
    for i, c in enumerate(text):
        held += c
        after = text[i + 1:i + 2]
        stop = c in ".!?;:" and after.isspace() or c == "\n"
        if not text.isascii() and not after == "" and after not in S.STOPS + S._CLOSING + ".!?":
            stop = stop or c in S.STOPS or (c in S._CLOSING and text[i - 1:i] != "" and text[i - 1] in S.STOPS and i > 0)
        if stop or i == len(text) - 1:
            out += clauses(held)
            held = ""
    return [(x, " ".join(re.findall("[0-9a-z\x80-\U0010ffff]+", x.translate(UP)))) for x in out]


def clauses(sentence):
    if sentence.count(" ") + sentence.count("\t") < 16:
        return [sentence]
    out, held = [], ""
    for i, c in enumerate(sentence):
        held += c
        if c == "," and sentence[i + 1:i + 2].isspace() and len(held.split()) >= 8:
            out.append(held)
            held = ""
    out += [held] if held else []
    short = []
    for x in out:
        if len(x.split()) <= 24:
            short.append(x)
            continue
        held = ""
        for i, c in enumerate(x):
            held += c
            ends_word = c.isspace() and not x[i + 1:i + 2].isspace() and held.strip() and x[i + 1:i + 2]
            if ends_word:
                word = held.split()[-1].translate(UP)
                word = "".join(y if y.isalnum() or ord(y) > 127 else " " for y in word)
                if zlib.crc32(word.encode()) % 8 == 0:
                    short.append(held)
                    held = ""
        short += [held] if held else []
    return short


def brute(rows, min_words=25):
    """{(id, text): numbers of the sentences that go}: every place of every run, all compared."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    places = {}
    for d, t in dict.fromkeys(rows):
        said = [k for _, k in cut(t) if k]
        n = [len(k.split()) if k.isascii() else max(len(k.split()), len(S._UNSPACED.findall(k))) for k in said]
        spans = set()
        for a in range(len(said)):
            e = next((e for e in range(a + 1, len(said) + 1) if sum(n[a:e]) >= min_words), None)
            spans |= {(a, e)} if e else set()
        tail = [a for a in range(len(said)) if sum(n[a:]) >= min_words]
        spans |= {(max(tail), len(said))} if tail else {(0, len(said))} if said else set()
        for a, e in spans:
            places.setdefault("\n".join(said[a:e]), []).append((key((d, t)), a, e, d, t))
    gone = {}
    for where in places.values():
        for p in sorted(where, key=lambda p: p[:2])[1:]:
            gone.setdefault((p[3], p[4]), set()).update(range(p[1], p[2]))
    return {(d, t): gone.get((d, t), set()) for d, t in dict.fromkeys(rows)}


def data(seed):
    rnd = random.Random(seed)
    say = lambda: " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(30)) for _ in range(rnd.randrange(1, 9))) + rnd.choice([". ", "!  ", "? ", "\n"])
    passage = ["".join(say() for _ in range(rnd.randrange(3, 9))) for _ in range(6)]
    rows = []
    for d in range(80):
        parts = ["".join(say() for _ in range(rnd.randrange(0, 6))) for _ in range(3)]
        if rnd.random() < 0.6:
            parts.insert(1, rnd.choice(passage).upper() + "\n")
        rows.append((d, "".join(parts)))
    return rows


def check(got, rows):
    want, at = brute(rows), Counter()
    for d, t in rows:
        parts, out, i = cut(t), [], -1
        n = sum(bool(k) for _, k in parts)
        for p, k in parts:
            i += bool(k)
            out += [p] if not (k and i in want[(d, t)]) else []
        at[(d, n, len(want[(d, t)]), (t if not want[(d, t)] else "".join(out)))] += 1
    assert Counter((r.doc_id, r.n_sentences, r.n_removed, r.text) for r in got) == at


TEXTS = ["One, two. Three; four: five\n six", "a" * 30, " ".join(f"w{i}" for i in range(90)), "  lead " + "x, " * 60, "a, b c d e f g h i, j k l m n o p q, r s.",
         "「好。」他说！！走吧", "राम घर गया आज सुबह। सीता वन गई।", "e.g. this... and\t\tthat!\n\n", ". . .", "é " * 70 + "end.", "A" * 5 + "。" * 3 + "x" + "。」" + "y " * 40]


def test_cuts_equal_a_walk_over_the_characters():
    for t in TEXTS + [t for _, t in data(3)] + [t for _, t in AWKWARD if t and len(t) < 1000]:
        got = S.pieces(t)
        assert "".join(got) == t and all(got)
        assert list(zip(got, [k.decode() for k in S.sentence_keys(got)])) == cut(t), t


def test_equals_brute_force(docs):
    small = [r for r in AWKWARD if len(r[1] or "") < 1000]
    rows = data(1) + small + [(d, t) for d, t in enumerate(TEXTS, 2000)] + [(3000 + d, t + " tail.") for d, t in enumerate(TEXTS)]
    rows += [(905, "Same text twice. It is the same. All of it is here again.")] * 2 + [(None, rows[3][1])]
    check(S.deduplicated(docs(rows)).collect(), rows)


def test_brute_force_over_many_partitions(docs, spark):
    """Runs that most documents hold lie over the edges of many partitions."""
    rows = data(2) + [(500 + i, data(2)[i % 3][1]) for i in range(60)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        check(S.deduplicated(docs(rows, 9)).collect(), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_long_texts_null_ids_and_other_columns(docs):
    got = S.deduplicated(docs(AWKWARD + [(None, "word " * 60_000)]))
    assert {"h1", "pos", "lang", "n_chars", "n_sentences", "n_removed"} <= set(got.columns)
    rows = {(r.doc_id, len(r.text or "")): r for r in got.collect()}
    assert rows[None, len("no id here but some text")].n_removed == 0
    assert sum(r.n_removed > 0 for r in rows.values() if r.n_sentences > 1) <= 2      # repeats within, and the later copy


def test_long_passage_goes_from_all_but_the_first(docs):
    passage = " ".join(f"Sentence number {i} of the shared passage." for i in range(12))
    rows = [(i, f"Own start {i}. {passage} Own end {i}.") for i in range(30)] + [(99, "A clean text. It is short. Nothing more to say here now.")]
    got = {r.doc_id: r for r in S.deduplicated(docs(rows)).collect()}
    assert got[0].n_removed == 0 and got[99].n_removed == 0
    assert all(got[i].text.split() == f"Own start {i}. Own end {i}.".split() for i in range(1, 30))


def test_passages_of_any_shape(docs):
    """Over 50 words within texts of their own: one sentence, many short ones, no stop at all, cut inside sentences."""
    w = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    shapes = [w("s", 60) + ".", " ".join(f"W{i}!" for i in range(60)), w("n", 70), w("c", 30) + ", " + w("d", 30), "".join(f"x{i} y{i},\n" for i in range(30)),
              "".join(f"{c}今天天气很好吗。" for c in "甲乙丙丁戊己庚辛"), "राम घर गया आज सुबह। सीता वन गई कल शाम। लक्ष्मण भी साथ गया था उस दिन। फिर सब लौट आए घर अपने। रात को बहुत बारिश हुई वहाँ। सुबह सब खेत पर गए काम करने। शाम को मेला लगा गाँव के बाहर। बच्चे खुश हुए और नाचे बहुत देर।"]
    rows = []
    for k, p in enumerate(shapes):
        rows += [(10 * k, f"Own words {w('o%d' % k, 20)} {p} {w('e%d' % k, 20)}"), (10 * k + 1, f"{w('f%d' % k, 40)} {p} other words {w('g%d' % k, 9)}.")]
    got = {r.doc_id: r for r in S.deduplicated(docs(rows)).collect()}
    for k, p in enumerate(shapes):
        assert got[10 * k].n_removed == 0
        left = got[10 * k + 1].text
        assert got[10 * k + 1].n_removed > 0 and len(left) < len(dict(rows)[10 * k + 1]) - len(p) / 2, (k, left)
        assert f"g{k}8." in left and f"f{k}0" in left


def test_short_texts_go_as_copies_only(docs):
    rows = [(4, "Yes. No. Maybe."), (5, "Yes. No. Maybe."), (6, "Yes. No. Maybe. And more."), (7, "A short note"), (8, "a  SHORT note!"), (9, "")]
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in S.deduplicated(docs(rows)).collect()}
    assert got == {4: (3, 0, "Yes. No. Maybe."), 5: (3, 3, ""), 6: (4, 0, rows[2][1]), 7: (1, 0, "A short note"), 8: (1, 1, ""), 9: (0, 0, "")}


def test_empty_table(docs):
    assert S.deduplicated(docs([])).collect() == []
