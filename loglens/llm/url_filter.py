"""URL filter: a cascade of Bloom filters gives exact rule membership without joins.

A rule is (host, path, action). It fits a url of its host or a subdomain whose path starts
with the rule's path; the longest key ``host + path`` wins, then the longer host. The keys a
url could match are its last labels (as many as the longest rule host has) times the path's
prefixes of the rules' lengths; over all urls these keys are the corpus's key universe.

For each action, level 1 encodes the listed keys, level 2 the keys of the universe that pass
level 1 though not listed, level 3 the listed keys that pass level 2, and so on until a level
would be empty. Then ``L1 and not (L2 and not (L3 ...))`` is exact for every key of the
universe. Level 1's false positive rate is set to about listed / universe, so each level holds
about as many keys as are listed: the filters grow with the list (and the logarithm of the
universe), not with the corpus. They enter the plan as literals. ``max_listed`` bounds the list;
a longer one is turned down with an error, as a join is the better plan for it.

Everything is DataFrame functions; the universe is scanned once, for level 2.

Defined cases: a null url, or one without ``://``, has an empty host and path, which no rule
fits. A url without a fitting rule gets ``default``. A rule with a null host or path is left
out; a key listed as both allow and block blocks. Every row of the table is judged on its own,
repeated or not. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

_HASHES = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _position(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level * _HASHES + i), key), F.lit(bits))


def _bloom(keys: DataFrame, level: int, n: int, rate: float) -> tuple[int, list[int]]:
    """(number of bits, words of 64 bits) of a Bloom filter over ``keys.key``."""
    bits = 64 * max(1, math.ceil(-_HASHES * n / math.log(1 - rate ** (1 / _HASHES)) / 64))
    at = F.explode(F.array(*[_position(F.col("key"), level, i, bits) for i in range(_HASHES)]))
    rows = (keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(63).cast("int"))).alias("w")))
    words = [0] * (bits // 64)
    for r in rows.collect():            # as many words as the filter has
        words[r["word"]] = r["w"]
    return bits, words


def _passes(key: Column, level: int, bloom: tuple[int, list[int]]) -> Column:
    bits, words = bloom
    table = F.lit(words).cast("array<bigint>")
    ok = F.lit(True)
    for i in range(_HASHES):
        at = _position(key, level, i, bits)
        word = F.element_at(table, (F.shiftright(at, 6) + 1).cast("int"))
        ok = ok & (F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
    return ok


class Cascade:
    """Exact membership of a key in a list, for keys of a universe."""

    def __init__(self, levels: list[tuple[int, list[int]]]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, n_universe: int) -> Cascade:
        n = listed.count()
        if n == 0:
            return cls([])
        rate = min(0.5, max(1e-9, n / max(1, n_universe)))
        levels = [_bloom(listed, 1, n, rate)]
        # The only pass over the universe; what passes level 1 is about as many keys as are listed.
        wrong = stored(universe.filter(_passes(F.col("key"), 1, levels[0])).distinct()
                       .join(listed, "key", "left_anti"))
        sides, m = [wrong, listed], 0
        while True:
            mine = sides[m % 2]
            if m:                               # what the other side's last level lets through
                mine = mine.filter(_passes(F.col("key"), len(levels), levels[-1]))
            n = mine.count()
            if n == 0:
                return cls(levels)
            levels.append(_bloom(mine, len(levels) + 1, n, 0.5 ** 4))
            sides[m % 2], m = mine, m + 1

    def member(self, key: Column) -> Column:
        out = F.lit(False) if len(self.levels) % 2 == 0 else F.lit(True)
        for k in range(len(self.levels), 0, -1):
            out = F.when(_passes(key, k, self.levels[k - 1]), out).otherwise(F.lit(k % 2 == 0))
        return out


def candidates(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """The keys that a rule of at most ``labels`` labels and one of the path ``lengths`` could have."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(labels), n)),
                       lambda m: F.array_join(F.slice(parts, n - m + 1, m), "."))
    fit = F.filter(F.lit(list(lengths)), lambda k: k <= F.length(path))
    heads = F.transform(fit, lambda k: F.substring(path, F.lit(1), k))
    pairs = F.transform(ends, lambda h: F.transform(heads, lambda p: F.struct(
        (F.length(h) + F.length(p)).alias("size"), F.length(h).alias("host_size"), F.concat(h, p).alias("key"))))
    return F.flatten(pairs)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",),
          default: str = "allow", max_listed: int = 1_000_000) -> DataFrame:
    """``keep``, host, path, rule (the longest fitting key) and verdict for every row of ``pages``."""
    spark = pages.sparkSession
    listed = (rules.filter("host IS NOT NULL AND path IS NOT NULL")
              .select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "action")
              .withColumn("key", F.concat("host", "path")))
    found = listed.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"),
                       F.collect_set(F.length("path")).alias("lengths")).first()
    made = {"host", "path", "rule", "verdict"}
    cols = [c for c in keep if c not in made]
    base = pages.select(*cols, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if found["n"] == 0:
        return base.select(*cols, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if found["n"] > max_listed:
        raise ValueError(f"{found['n']} rules; the filters are built for at most {max_listed}")
    labels, lengths = found["labels"], sorted(found["lengths"])
    cand = candidates(F.col("host"), F.col("path"), labels, lengths)
    block = listed.filter("action = 'block'").select("key").distinct()
    allow = listed.filter("action <> 'block'").select("key").distinct().join(block, "key", "left_anti")
    universe = base.select(F.explode(cand).alias("c")).select("c.key")
    n_universe = pages.count() * labels * len(lengths)
    blocks, allows = (Cascade.build(x, universe, n_universe) for x in (block, allow))
    hits = F.filter(cand, lambda c: blocks.member(c["key"]) | allows.member(c["key"]))
    best = base.withColumn("_best", F.array_max(hits)["key"])
    verdict = (F.when(F.col("_best").isNull(), F.lit(default))
               .when(blocks.member(F.col("_best")), F.lit("block")).otherwise(F.lit("allow")))
    return best.select(*cols, "host", "path", F.col("_best").alias("rule"), verdict.alias("verdict"))
