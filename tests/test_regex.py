"""Translated patterns find what Python finds: by hand, and for patterns made at random."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loglens.functions import regex as R
from loglens.functions.text import match_spans

pytestmark = pytest.mark.filterwarnings("ignore::FutureWarning")
TEXTS = ["", "a", "ab", "aab c", "error 12: Lost executor 3", "ÉCHEC éclair 4\u0664", "x\ny\n", "k \u212a K s \u017f S i \u0130 \u0131 I",
         "a.b*c [d] {e} (f) ^g$ |h\\", "foo_bar-baz foo", "\u00a0\u2003tab\tend", "aXbXc", "<<a>> <b>", "abcabcabc", "日本語 text ß ẞ",
         "line one\nline two", "caseCASE CaSe", "a-b]c", "1e5 0x1F", "\U0001F600 smile"]


def spans_in_spark(spark, pairs):
    """{(pattern number, text number): spans}: Spark's engine, pattern by pattern."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "t int, text string").coalesce(1)
    out = {}
    for a in range(0, len(pairs), 40):
        cols = [match_spans(F.col("text"), java).alias(f"p{a + i}") for i, (_, java) in enumerate(pairs[a:a + 40])]
        for r in df.select("t", *cols).collect():
            for i in range(len(cols)):
                out[a + i, r.t] = [(s.start, s.end) for s in r[f"p{a + i}"]]
    return out


def assert_equal(spark, patterns, flags=0):
    pairs = [(p, R.to_java(p, flags)) for p in patterns]
    got = spans_in_spark(spark, pairs)
    for i, (p, java) in enumerate(pairs):
        for t, text in enumerate(TEXTS):
            want = [m.span() for m in re.finditer(p, text, flags)]
            if R.spans_differ(p, flags):
                assert bool(got[i, t]) == bool(want), (p, java, text)
            else:
                assert got[i, t] == want, (p, java, text)


BY_HAND = [r"\d+", r"\w+", r"\s", r"\S+", r"\W", r"\D\d", r"[^\W\d_]+", r"[\d\s]", r"[^\s]", r"[[]", r"[A[]", r"[]a]", r"[^]a]", r"[a\-b]", r"a.b",
            r"^.", r"$", r"\Ax?", r"c\Z", r"\bfoo\b", r"\Bo", r"(a)?(?(1)b|c)", r"(<)?(\w)(?(1)>|)", r"(?P<q>[ab])(?P=q)", r"(a)(b)?\1",
            r"(?i)case", r"(?i:k)s", r"(?i)[i-s]", r"(?i)[^k]", r"(?i)é", r"(?i)ß", r"(?s)e.l", r"(?m)^l", r"(?m)e$", r"a*?b", r"(?:ab|a)(?:c|bc)?",
            r"(?<=a)b", r"(?<!o)o", r"(?=X)", r"(?!a)\w", r"(?x) a  b # c", r"\.\*", r"\[d\]", r"[(){}|^$*+?.\\]", r"x*", r"(abc){2}", r"a{1,2}", r"a{,2}b",
            r"\x41|\u00e9|\N{LATIN SMALL LETTER A}", r"(?a)\w+", r"(?a:\d)", r"(?>a+)b", r"a++", r"[\U0001F600-\U0001F610]", r"(|a)+", r"(?i)\u212a",
            r"((a)|b)+(?(2)c| )", r"(?i)([ac])\1", r"\\", r"-", r"[a-c&&b]", r"[a&&b]+", r"#", r"\Q"[:1] * 0 + r"\ ", r"[ -~]+"]


def test_by_hand(spark):
    assert_equal(spark, BY_HAND)


def test_by_hand_with_flags(spark):
    assert_equal(spark, [p for p in BY_HAND if "(?a" not in p], re.IGNORECASE | re.MULTILINE)


def made(rng, depth=0):
    """A random pattern."""
    pick = rng.random()
    if depth > 3 or pick < 0.35:
        return rng.choice(["a", "b", "c", "X", "k", "é", r"\.", r"\d", r"\w", r"\s", ".", "[a-c]", "[^a]", "[^\\W]", r"[\dx]", r"\b", "^", "$", "[K-i]", " ", "foo", "ss"])
    if pick < 0.6:
        return "".join(made(rng, depth + 1) for _ in range(rng.randint(1, 3)))
    if pick < 0.72:
        return f"(?:{made(rng, depth + 1)}|{made(rng, depth + 1)})"
    if pick < 0.8:
        return f"({made(rng, depth + 1)})"
    if pick < 0.84:
        return f"(?{rng.choice(['=', '!'])}{made(rng, depth + 1)})"
    return f"(?:{made(rng, depth + 1)}){rng.choice(['?', '*', '+', '{1,2}', '*?', '+?', '??', '{2}'])}"


@pytest.mark.parametrize("seed, flags", [(1, 0), (2, re.IGNORECASE), (3, re.MULTILINE), (4, re.IGNORECASE | re.DOTALL)])
def test_made_patterns(spark, seed, flags):
    rng = random.Random(seed)
    assert_equal(spark, [made(rng) for _ in range(60)], flags)


def test_classes_of_all_code_points(spark):
    """Digits, words and blanks over every code point that both Unicode versions know."""
    rows = spark.range(0x110000).where("id < 55296 OR id > 57343").select(
        "id", *[F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").rlike(R.to_java(p)).alias(n)
                for n, p in (("d", r"\d"), ("s", r"\s"), ("w", r"\w"), ("known", ""))],
        F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").rlike(r"\p{IsAssigned}").alias("assigned"))
    for r in rows.where("assigned AND (d OR s OR w OR id < 65536)").collect():
        c = chr(r.id)
        assert (r.d, r.s, r.w) == tuple(bool(re.match(p, c)) for p in (r"\d", r"\s", r"\w")), hex(r.id)


@pytest.mark.parametrize("bad", [r"(a)(?<=\1)", "\ud800", r"(a)(?<=(?(1)a|b))"])
def test_refused_with_a_reason(bad):
    with pytest.raises(R.Refused) as e:
        R.to_java(bad)
    assert str(e.value)


def test_invalid_in_python():
    with pytest.raises(re.error):
        R.to_java("[a")


def test_required_literals():
    assert R.required("OutOfMemoryError") == ["outofmemoryerror"]
    assert R.required(r"Lost executor \d+") == ["lost executor "]
    assert R.required(r"ab(cd)+ef") == ["abcd"]
    assert R.required(r"foo\bbar") == ["foobar"]
    assert R.required(r"one|three(four)?") == ["one", "three"]
    assert R.required(r"\d+") == R.required("a|") == R.required("a*") == []
    assert R.required(r"x[ab]long é tail") == ["long "] or R.required(r"x[ab]long é tail") == [" tail"]


def test_every_match_holds_a_required_text():
    rng = random.Random(11)
    fold = str.maketrans("\u0130\u0131\u017f\u212a", "iisk")
    for _ in range(600):
        p = made(rng)
        need = R.required(p, re.IGNORECASE)
        for t in TEXTS:
            if need and re.search(p, t, re.IGNORECASE):
                assert any(n in t.translate(fold).lower() for n in need), (p, t)
