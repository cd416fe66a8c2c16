"""Filter interaction audit: what each filter removes, in every order of the filters.

1. One pass over the texts measures them and gives a row for each id: (doc, text digest), part,
   number of equal rows, the filters whose condition on the text holds. Copies of a text with a
   smaller id are the last filter's relation; the texts of many copies, a thousandth of the rows
   or more, are broadcast for it and the rest joined (``skew.left_join``).
2. One id table for each filter is written: the ids that fail it.
3. Each table meets the ids once, by a left-semi join (they fail it too) and a left-anti join (they
   don't). What the ids then share, the set of filters they fail, is a region; a region's ids
   have one fate in every order. So the ids are shuffled as often as there are filters, not for
   each of the prefixes.
4. Survivors of a prefix: regions left-anti joined with the regions that one of its filters
   fails; those already gone: left-semi. Joined with the next filter's regions they give its
   removals, its redundancies and what the labels lose.

Defined cases: a null text is empty; a null part is the empty string. A null id is never a copy
and no id is a copy of it; it has no labels. Rows with the same id, text and part are counted
each. An id with several rows in ``labels`` is good (toxic) if one of them says so. Columns of the documents
other than id, text and part are not read. An empty table has no parts, so no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .skew import left_join

#: Failure conditions over a text's measures; the names are one letter each.
CONDITIONS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 3 * n_points",
    "D": "has_symbol",
}
COPIES = "E"
_WORD = r"[^\x20\x09-\x0D]+"
_COUNTS = ("n", "good", "toxic")


def measured(docs: DataFrame, doc: str, text: str, part: str) -> DataFrame:
    """(doc, digest, part, n_words, n_distinct, n_upper, n_points, has_symbol) of every row."""
    rows = docs.select(F.col(doc).cast("bigint").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body"),
                       F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("words", F.regexp_extract_all("body", F.lit(_WORD), F.lit(0)))
    return rows.select("doc", F.md5("body").alias("digest"), "part", F.size("words").cast("bigint").alias("n_words"),
                       F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
                       F.length(F.regexp_replace("body", "[^A-Z]+", "")).cast("bigint").alias("n_upper"),
                       F.length("body").cast("bigint").alias("n_points"), F.col("body").rlike("[#$%&*|]").alias("has_symbol"))


def id_tables(docs: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "lang",
              conditions: dict[str, str] = CONDITIONS, copies: str = COPIES) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Ids (doc, digest, part, n: rows), and for each filter the table of (doc, digest) that fail it."""
    failing = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(f)) for f, c in conditions.items())))
    ids = stored(measured(docs, doc, text, part).withColumn("fails", failing)
                 .groupBy("doc", "digest", "part").agg(F.count("*").alias("n"), F.first("fails").alias("fails")))
    texts = stored(ids.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("rows"))
                   .filter("first < last").select("digest", "first", "rows"))
    again = left_join(ids.select("doc", "digest"), texts, "digest", "rows", ids.count(), "doc").filter("doc > first")
    rows = ids.select("doc", "digest", F.explode("fails").alias("filter")).unionByName(
        again.select("doc", "digest", F.lit(copies).alias("filter")))
    every = stored(rows.distinct(), by="filter")
    return ids.drop("fails"), {f: every.filter(F.col("filter") == f).select("doc", "digest") for f in [*conditions, copies]}


def with_labels(ids: DataFrame, labels: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Ids with good and toxic: the number of their rows that are labelled so."""
    marks = labels.filter(F.col(doc).isNotNull()).groupBy(F.col(doc).cast("bigint").alias("of")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    known = ids.filter("doc IS NOT NULL").join(marks, F.col("doc") == F.col("of"), "left").drop("of")
    none = ids.filter("doc IS NULL").withColumn("good", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))
    return known.unionByName(none).withColumns({c: F.col("n") * F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def regions(ids: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(part, fails, n, good, toxic): the ids summed by the set of filters that they fail."""
    left = ids.withColumn("fails", F.lit(""))
    for name in sorted(tables):
        far = tables[name].select(F.col("doc").alias("far_doc"), F.col("digest").alias("far_digest"))
        same = F.col("doc").eqNullSafe(F.col("far_doc")) & (F.col("digest") == F.col("far_digest"))
        inside = left.join(far, same, "left_semi").withColumn("fails", F.concat("fails", F.lit(name)))
        left = stored(inside.unionByName(left.join(far, same, "left_anti")))
    return stored(left.groupBy("part", "fails").agg(*(F.sum(c).alias(c) for c in _COUNTS)))


def _sorted_letters(c) -> F.Column:
    return F.array_join(F.array_sort(F.split(c, "")), "")


def audit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "lang",
          conditions: dict[str, str] = CONDITIONS, copies: str = COPIES) -> DataFrame:
    """A row for each part, order of the filters and step; counts of documents in the part."""
    names = sorted([*conditions, copies])
    ids, tables = id_tables(docs, doc, text, part, conditions, copies)
    region = regions(with_labels(ids, labels), tables)

    # Fixed by the number of filters: the sets that can stand before a step, and their letters.
    sets = ["".join(s) for k in range(len(names) + 1) for s in itertools.combinations(names, k)]
    cells = region.withColumn("before", F.explode(F.lit(sets)))
    region_letter = region.select("fails").distinct().select("fails", F.explode(F.split("fails", "")).alias("filter")).filter("filter <> ''")
    set_letter = (region.select(F.explode(F.lit(sets)).alias("before")).distinct()
                  .select("before", F.explode(F.split("before", "")).alias("filter")).filter("filter <> ''"))
    hit = stored(set_letter.join(region_letter, "filter").select("before", "fails").distinct())
    alive = cells.join(F.broadcast(hit), ["before", "fails"], "left_anti")
    dead = cells.join(F.broadcast(hit), ["before", "fails"], "left_semi")

    kept = alive.groupBy("part", F.col("before").alias("after")).agg(F.sum("n").alias("kept"))
    next_filter = F.broadcast(region_letter)
    removed = (alive.join(next_filter, "fails").groupBy("part", "before", "filter")
               .agg(F.sum("n").alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost")))
    redundant = (dead.join(next_filter, "fails").groupBy("part", "before", "filter").agg(F.sum("n").alias("redundant")))
    alone = region.filter("length(fails) = 1").select("part", F.col("fails").alias("filter"), F.col("n").alias("unique_fails"))

    orders = ["".join(o) for o in itertools.permutations(names)]
    steps = (region.select("part").distinct().withColumn("filter_order", F.explode(F.lit(orders)))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
             .withColumn("filter", F.expr("substring(filter_order, step, 1)"))
             .withColumn("before", _sorted_letters(F.expr("substring(filter_order, 1, step - 1)")))
             .withColumn("after", _sorted_letters(F.expr("substring(filter_order, 1, step)"))))
    got = (steps.join(kept, ["part", "after"], "left").join(removed, ["part", "before", "filter"], "left")
           .join(redundant, ["part", "before", "filter"], "left").join(alone, ["part", "filter"], "left"))
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    got = stored(got.select("part", "filter_order", "step", "filter", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts)))
    total = got.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return got.join(total, ["part", "filter"]).select("part", "filter_order", "step", *counts, "shapley")
