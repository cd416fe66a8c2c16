import random

import pytest

from loglens.llm import url_filter as U

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("b.example.org", "", "block"), (None, "/", "block"), ("net", None, "block"), ("com", "/de/", "allow")]


def brute(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
    path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p) for h, p, _ in RULES
            if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits)[2] if fits else None
    verdict = "allow"
    if rule is not None:
        verdict = "block" if any(a == "block" for h, p, a in RULES if h is not None and p is not None and h + p == rule) else "allow"
    return host, path, rule, verdict


def urls(n):
    rnd = random.Random(3)
    hosts = ["example.org", "a.EXAMPLE.org", "b.example.org", "c.b.example.org", "x.com", "com", "notcom", "example.orgs", "", "a..org", "net"]
    paths = ["", "/", "/en/1", "/en/123", "/en/2", "/es/x", "/es", "/fr/ü", "/de/", "/DE/", "//"]
    out = [f"{rnd.choice(['http', 'https', ''])}://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?q=://x/de/', '#a', '?'])}" for _ in range(n)]
    return out + [None, "", "example.org/es/", "http:/example.org/", "a://b://example.org/es/", "http://" + "a." * 3000 + "org/" + "p" * 100_000]


def test_equals_brute_force(spark):
    rows = [(i, u, "clash") for i, u in enumerate(urls(400))] + [(None, "http://x.org/", "r"), (1, "http://x.org/", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string").repartition(4)
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, rules).collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u, _ in rows), key=str)


def test_empty(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(none, rules).collect() == []
    one = spark.createDataFrame([(1, "http://a.org/")], none.schema)
    assert U.judge(one, rules.limit(0)).collect()[0].verdict == "allow"
    with pytest.raises(ValueError):
        U.judge(one, rules, max_listed=2)


def test_cascade_is_exact_when_its_first_levels_are_poor(spark, monkeypatch):
    """With a small universe given, level 1 lets much through; the further levels make up for it."""
    listed = spark.range(300).selectExpr("concat('k', id) AS key")
    universe = spark.range(6000).selectExpr("concat('k', id * 3 % 6007) AS key")
    cascade = U.Cascade.build(listed, universe, 400)
    assert len(cascade.levels) >= 3
    from pyspark.sql import functions as F
    got = {r.key for r in universe.unionByName(listed).filter(cascade.member(F.col("key"))).collect()}
    assert got == {f"k{i}" for i in range(300)}
