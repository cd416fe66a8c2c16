"""Investigation cases as a table: the control policy, keyword sets, claim
scoring and evidence lookups of the original agent loop, expressed as
column rules and joins so that many cases are triaged in one job.

A *case* row carries the state of one investigation (iteration, last
status, confidence, critic verdict, proposed action, keyword lists, draft
text, claimed evidence keys). Evidence per case is a keyed table
``(case_id, pattern, count)``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gcparse as G
from ..functions import patterns as P
from ..functions.text import dedupe_keep_order
from ..session import stored
from .ordered import index_in_order, slice_by_order


def clip(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def _marker_count(text: Column, marker: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit(""))))
            / len(marker)).cast("int")


def claim_confidence(cases: DataFrame, text_col: str = "rca") -> DataFrame:
    """proven / (proven + inferred) claim markers, 2 decimals (half-even);
    0.0 when the text has no marked claim."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    p, i = _marker_count(t, P.CLAIM_PROVEN), _marker_count(t, P.CLAIM_INFERRED)
    return cases.select(
        "case_id", p.alias("proven"), (p + i).alias("claims"),
        F.when(p + i > 0, F.bround(p / (p + i), 2)).otherwise(0.0).alias("claim_confidence"))


def critic_gate(cases: DataFrame) -> DataFrame:
    """Critic verdict: adjustment clipped to +-0.25, confidence to [0, 1];
    below 0.6 the draft is rejected and the reason says so."""
    adj = clip(F.coalesce(F.col("critic_adjust"), F.lit(0.0)),
               -P.CRITIC_MAX_ADJUST, P.CRITIC_MAX_ADJUST)
    conf = clip(F.coalesce(F.col("confidence"), F.lit(0.5)) + adj, 0.0, 1.0)
    reasons = G.py_strip(F.coalesce(F.col("critic_reasons"), F.lit("")))
    low = conf < P.CRITIC_MIN_CONFIDENCE
    critique = (F.when(low & (reasons == ""), F.lit(P.CRITIC_LOW_DEFAULT))
                .when(low, F.concat(G.py_format(P.CRITIC_LOW_PREFIX, conf), reasons))
                .otherwise(reasons))
    return cases.select("case_id", (F.col("critic_approve") & ~low).alias("critic_approved"),
                        critique.alias("critique"), conf.alias("confidence"))


def next_action(cases: DataFrame, max_iter: int = P.MAX_OUTER_ITERATIONS,
                threshold: float = P.CONFIDENCE_THRESHOLD, strict: bool = False) -> DataFrame:
    """Supervisor policy: allowed actions per stage, a proposed action inside
    them wins, else the fallback chain; iteration + 1 on a new reasoning
    cycle. As coded, the confidence threshold only guards the fallback;
    ``strict=True`` also keeps a proposed ``end`` out until it is met."""
    it, st = F.col("iteration"), F.coalesce(F.col("last_status"), F.lit(""))
    ok, conf = F.coalesce(F.col("critic_approved"), F.lit(False)), F.col("confidence")
    prop = F.lower(G.py_strip(F.coalesce(F.col("proposed_action"), F.lit(""))))
    can_end = ok & (conf >= threshold) if strict else ok
    allowed = (F.when(it == 0, F.array(F.lit("reasoning")))
               .when((st == "summarized") & ~ok, F.array(F.lit("critic"), F.lit("reasoning")))
               .when(can_end, F.array(F.lit("end"), F.lit("reasoning")))
               .otherwise(F.array(F.lit("reasoning"))))
    fallback = (F.when(it == 0, F.lit("reasoning"))
                .when((st == "summarized") & ~ok, F.lit("critic"))
                .when(ok & (conf >= threshold), F.lit("end"))
                .otherwise(F.lit("reasoning")))
    nxt = (F.when((it >= max_iter) & (st != ""), F.lit("end"))
           .when(F.array_contains(allowed, prop), prop)
           .otherwise(fallback))
    return cases.select(
        "case_id", F.array_join(allowed, "|").alias("allowed_actions"), nxt.alias("next_action"),
        F.when(nxt == "reasoning", it + 1).otherwise(it).alias("new_iteration"))


def keyword_union(cases: DataFrame, cap: int = P.KEYWORD_CAP) -> DataFrame:
    """Defaults first, then suggestions, deduplicated case-insensitively (first
    spelling kept), capped; then merged after the keywords already held."""
    defaults = F.array(*[F.lit(k) for k in P.DEFAULT_KEYWORDS])
    fresh = F.slice(dedupe_keep_order(F.concat(defaults, F.col("suggested"))), 1, cap)
    merged = dedupe_keep_order(F.concat(F.col("existing"), fresh))
    return cases.select("case_id", fresh.alias("generated"), merged.alias("keywords"))


def keyword_new(cases: DataFrame, cap: int = P.KEYWORD_CAP) -> DataFrame:
    """Generated keywords not searched before (case-insensitive anti-set)."""
    u = keyword_union(cases, cap).join(cases.select("case_id", "existing"), "case_id")
    new = F.filter(F.col("generated"), lambda k: ~F.exists(
        F.col("existing"), lambda e: F.lower(e) == F.lower(k)))
    return u.select("case_id", new.alias("new_keywords"))


def loop_done(cases: DataFrame, new_kw: DataFrame,
              max_loops: int = P.MAX_ANALYZE_PARSE_LOOPS) -> DataFrame:
    """Evidence loop stop: loop count reached, or no new keyword after the
    first pass."""
    x = cases.select("case_id", (F.col("analyze_parse_loops") + 1).alias("loops")).join(
        new_kw, "case_id")
    n_new = F.size("new_keywords")
    done = (F.col("loops") >= max_loops) | ((n_new == 0) & (F.col("loops") > 1))
    return x.select("case_id", "loops", n_new.cast("bigint").alias("n_new"),
                    done.alias("analyzer_satisfied"))


def input_errors(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cases whose evidence holds a fatal-input key; those get the
    diagnostic draft with confidence 0. Missing logs path or empty keyword
    list add such keys."""
    synthetic = cases.select(
        "case_id", F.explode(F.array_compact(F.array(
            F.when(G.py_strip(F.coalesce(F.col("logs_path"), F.lit(""))) == "",
                   F.lit(P.NO_LOGS_PATH_KEY)),
            F.when(F.size(F.coalesce(F.col("keywords"), F.array())) == 0,
                   F.lit(P.NO_KEYWORDS_KEY))))).alias("pattern"))
    keys = evidence.select("case_id", "pattern").unionByName(synthetic)
    bad = F.lit(False)
    for m in P.FATAL_INPUT_MARKERS:
        bad = bad | F.col("pattern").contains(m)
    flags = keys.groupBy("case_id").agg(F.max(bad).alias("has_input_error"))
    out = cases.select("case_id").join(flags, "case_id", "left").select(
        "case_id", F.coalesce(F.col("has_input_error"), F.lit(False)).alias("has_input_error"))
    return out.select(
        "case_id", "has_input_error",
        F.when(F.col("has_input_error"), F.lit(P.INPUT_ERROR_PROBLEM)).alias("problem"),
        F.when(F.col("has_input_error"), F.lit(0.0)).alias("confidence"))


def diagnostic_draft(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """The draft of cases that cannot be analysed: (case_id, problem, rca, mitigation, confidence).

    A case gets one if a key of its evidence, or of what its input lacks, marks unusable input. ``rca`` holds each such
    key's first sample line, in the order of the keys; ``evidence`` has (case_id, pattern) and
    may have ``sample``.
    """
    path = G.py_strip(F.coalesce(F.col("logs_path"), F.lit("")))
    no_keywords = F.concat(F.lit(P.NO_KEYWORDS_SAMPLE), F.coalesce(F.col("logs_path"), F.lit("")))
    missing = cases.select("case_id", F.explode(F.array_compact(F.array(
        F.when(path == "", F.struct(F.lit(P.NO_LOGS_PATH_KEY).alias("pattern"), F.lit(P.NO_LOGS_PATH_SAMPLE).alias("sample"))),
        F.when((path != "") & (F.size(F.coalesce(F.col("keywords"), F.array())) == 0),
               F.struct(F.lit(P.NO_KEYWORDS_KEY).alias("pattern"), no_keywords.alias("sample")))))).alias("x")).select("case_id", "x.*")
    held = evidence.select("case_id", "pattern", (F.col("sample") if "sample" in evidence.columns else F.lit("")).alias("sample"))
    bad = F.lit(False)
    for m in P.FATAL_INPUT_MARKERS:
        bad = bad | F.col("pattern").contains(m)
    keys = held.unionByName(missing).where(bad).groupBy("case_id", "pattern").agg(F.min("sample").alias("sample"))
    # the keys that mark unusable input are few by their kind: one of each for a case
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("sample") != "", F.struct("pattern", "sample")))),
                                    lambda x: x["sample"]), "\n\n")
    return keys.groupBy("case_id").agg(text.alias("_t")).select(
        "case_id", F.lit(P.INPUT_ERROR_PROBLEM).alias("problem"), F.concat(F.lit("Root Cause: "), "_t").alias("rca"),
        F.lit(P.INPUT_ERROR_MITIGATION).alias("mitigation"), F.lit(0.0).alias("confidence"))


def hypotheses_union(cases: DataFrame, held: str = "hypotheses", fresh: str = "suggested_hypotheses") -> DataFrame:
    """Hypotheses held, then the new ones: trimmed, empty ones dropped, each once in its first spelling."""
    empty = F.array().cast("array<string>")
    return cases.select("case_id", dedupe_keep_order(F.concat(F.coalesce(held, empty), F.coalesce(fresh, empty))).alias("hypotheses"))


def needs_gc(cases: DataFrame) -> DataFrame:
    """Memory suspects: a held or suggested keyword names GC, heap, memory,
    OOM or pause."""
    kws = F.concat(F.col("existing"), F.col("suggested"))
    hint = "|".join(P.MEMORY_HINTS)
    return cases.select("case_id", F.exists(kws, lambda k: F.lower(k).rlike(hint))
                        .alias("needs_gc"))


def claims(cases: DataFrame) -> DataFrame:
    """(case_id, pos, key) of the evidence keys a draft claims."""
    return cases.select("case_id", F.posexplode("key_evidence").alias("pos", "key"))


def claims_supported(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    ev = evidence.select("case_id", F.col("pattern").alias("key"))
    return claims(cases).join(ev, ["case_id", "key"], "left_semi")


def claims_unsupported(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    ev = evidence.select("case_id", F.col("pattern").alias("key"))
    return claims(cases).join(ev, ["case_id", "key"], "left_anti")


def rules_table(spark: SparkSession) -> DataFrame:
    """The drill-down rules (a fixed, tiny lookup)."""
    return spark.createDataFrame(P.DRILLDOWN_RULES, "symptom string, cause string, keyword string")


def drilldown(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """Next keywords per case: observed classes joined to the rule table
    (broadcast: the rule table has a fixed, small size)."""
    obs = evidence.select("case_id", F.col("pattern").alias("symptom")).distinct()
    return obs.join(F.broadcast(rules), "symptom").select("case_id", "symptom", "cause", "keyword")


#: A round over the rules may make this many rows, however many its single steps would make.
_STEP_ROWS = 1 << 20
#: Rounds found since ``known`` was last written as one table.
_PARTS = 32


def _stride(ahead: DataFrame, known: DataFrame, reach: int) -> int:
    """How far a round goes: 0 if nothing is at the frontier, else the largest power of two up to ``reach`` whose join makes no
    more rows than as many single steps from this frontier, or ``_STEP_ROWS``."""
    if reach == 1:
        return 0 if ahead.isEmpty() else 1
    met = ahead.groupBy("mid").agg(F.count("*").alias("n"))
    held = known.groupBy(F.col("root").alias("mid"), F.ceil(F.log2("depth")).cast("int").alias("power")).agg(F.count("*").alias("m"))
    rows = met.join(held, "mid").groupBy("power").agg(F.sum(F.col("n") * F.col("m")).alias("rows")).collect()   # a row for each power of two
    made, best, single = 0, 0, 0
    for power, n in sorted(map(tuple, rows)):
        if 1 << power > reach:
            break
        made += n
        single = single or made
        if not best or made <= max(_STEP_ROWS, single << power):
            best = 1 << power
    return best


#: Rules of up to so many bytes (their names, and 16 for each rule) go whole to every task of ``close_rules``.
_HELD_BYTES = 64 << 20
#: (root, name) cells, and rules followed at a time, that a task of ``_walk_rules`` holds.
_CELLS = 1 << 20
#: Roots that a task of ``_walk_rules`` gets, at most.
_ROOTS_OF_TASK = 256
#: Bytes of paths that leave ``_walk_rules`` at a time.
_PATH_BYTES = 16 << 20


def _by_root(names, first, after, roots):
    """Arrow tables (root, cause, depth, via, path) of all that the roots lead to, breadth first.

    ``names`` are in order; rule i of name x leads to ``after[first[x] + i]``. As many roots as ``_CELLS`` allows go
    on together, a step at a time; a (root, name) pair is a cell, so the pairs of a step are sorted numbers."""
    n, none = len(names), np.iinfo(np.int32).max
    step = max(1, _CELLS // max(1, n))
    for at in range(0, len(roots), step):
        mine = roots[at:at + step]
        best = np.full(len(mine) * n, none, np.int32)            # the first name in front of a cell; -1: met in an earlier step
        front = np.arange(len(mine)) * n + mine
        best[front] = -1
        paths, depth = names.take(pa.array(mine)), 0
        while len(front):
            depth += 1
            node = front % n
            sizes = first[node + 1] - first[node]
            ends, fresh, i = np.cumsum(sizes), [], 0
            while i < len(front):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _CELLS, "right")))
                many, done = sizes[i:j], ends[j - 1]
                rule = np.repeat(first[node[i:j]] - (ends[i:j] - many), many) + np.arange(ends[i] - sizes[i], done)
                cell = np.repeat(front[i:j] - node[i:j], many) + after[rule]
                via = np.repeat(node[i:j].astype(np.int32), many)
                stay = best[cell] >= 0
                cell, via = cell[stay], via[stay]
                np.minimum.at(best, cell, via)
                fresh.append(np.unique(cell))
                i = j
            cells = np.unique(np.concatenate(fresh))
            via = best[cells].astype(np.int64)
            best[cells] = -1
            slot, cause = cells // n, cells % n
            behind = paths.take(pa.array(np.searchsorted(front, slot * n + via)))
            paths = pc.binary_join_element_wise(behind, names.take(pa.array(cause)), pa.scalar(" -> ", pa.large_string()))
            front = cells
            sizes = pc.fill_null(pc.binary_length(paths), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, i = np.cumsum(sizes), 0
            while i < len(cells):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _PATH_BYTES, "right")))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(mine[slot[i:j]])).cast(pa.string()), names.take(pa.array(cause[i:j])).cast(pa.string()),
                     pa.array(np.full(j - i, depth, np.int32)), names.take(pa.array(via[i:j])).cast(pa.string()),
                     paths.slice(i, j - i).cast(pa.string())], names=["root", "cause", "depth", "via", "path"])
                i = j


def _walk_rules(rules: DataFrame) -> DataFrame:
    """``close_rules`` where every task can hold the rules: each root is followed by one task, without a shuffle of pairs."""
    spark = rules.sparkSession
    table = rules.toArrow()
    symptom, cause = (table[c].combine_chunks().cast(pa.large_string()) for c in ("symptom", "cause"))
    names = pc.unique(pa.concat_arrays([symptom, cause]))
    names = names.take(pc.sort_indices(names))
    a, b = (pc.index_in(x, names).to_numpy(zero_copy_only=False).astype(np.int64) for x in (symptom, cause))
    order = np.lexsort((b, a))
    held = spark.sparkContext.broadcast((names, np.searchsorted(a[order], np.arange(len(names) + 1)), b[order]))
    roots = np.unique(a)

    def run(batches):
        for batch in batches:
            yield from _by_root(*held.value, batch.column(0).to_numpy())

    tasks = max(spark.sparkContext.defaultParallelism, -(-len(roots) // _ROOTS_OF_TASK))
    start = spark.createDataFrame(pa.table({"id": roots})).repartition(tasks, "id")
    return start.mapInArrow(run, "root string, cause string, depth int, via string, path string")


def close_rules(rules: DataFrame) -> DataFrame:
    """(root, cause, depth, via, path): what each symptom leads to, over the fewest rules.

    Every (root, cause) is reached once: a pair found before is never visited again, so cyclic
    rules end. ``via`` is the rule's symptom before the cause (of several at one depth
    the first by name), ``path`` the chain of them. Rules with a null, and from a symptom to itself, lead nowhere.

    Rules that prove to take ``_HELD_BYTES`` at most go to every task, and each task follows its roots (``_walk_rules``);
    more of them are joined in rounds (``_join_rules``). Both give the same rows.
    """
    rules = stored(rules.select("symptom", "cause").where("symptom <> cause").distinct())
    size = F.octet_length("symptom") + F.octet_length("cause") + 16
    held = rules.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return _walk_rules(rules) if held <= _HELD_BYTES else _join_rules(rules)


def _join_rules(rules: DataFrame) -> DataFrame:
    """``close_rules`` for rules of any number, without a null or a rule to itself.

    A round joins the frontier, the pairs at exactly the distance reached so far, with the pairs known up to a
    distance of ``_stride``: all, where that makes few rows, so that long chains take the logarithm of
    their length in rounds; the rules alone, where what lies behind the frontier is dense, so that a
    pair is not met once for every other pair. Paths are put together by doubling. Names are numbered in their
    order meanwhile.
    """
    names = rules.select(F.explode(F.array("symptom", "cause")).alias("name")).distinct()
    names = stored(index_in_order(slice_by_order(names, [F.col("name")]), "id").select("id", "name"))
    a, b = (names.select(F.col("name").alias(c), F.col("id").alias(i)) for c, i in (("symptom", "root"), ("cause", "to")))
    edge = rules.join(a, "symptom").join(b, "cause").select("root", F.col("to").alias("cause"), F.lit(1).alias("depth"), F.col("root").alias("via"))
    parts, reach = [stored(edge)], 1
    while True:
        if len(parts) > _PARTS:
            parts = [stored(reduce(DataFrame.unionByName, parts))]
        known = reduce(DataFrame.unionByName, parts)
        ahead = known.where(F.col("depth") == reach).select("root", F.col("cause").alias("mid"))
        step = _stride(ahead, known, reach)
        if not step:
            break
        behind = known.where(F.col("depth") <= step).select(F.col("root").alias("mid"), "cause", "depth", "via")
        # The least depth and of its symptoms the first, as one number: such minima are kept in place.
        met = (ahead.join(behind, "mid").where("root <> cause").groupBy("root", "cause")
               .agg(F.min(F.shiftleft(F.col("depth").cast("bigint"), 40) + F.col("via")).alias("best")))
        fresh = met.join(known.select("root", "cause"), ["root", "cause"], "left_anti")
        parts.append(stored(fresh.select("root", "cause", (F.shiftright("best", 40) + reach).cast("int").alias("depth"),
                                         F.col("best").bitwiseAND((1 << 40) - 1).alias("via"))))
        reach += step
    # A piece is the chain from behind ``top`` to the cause; pieces are put in front of each other until all begin at the root.
    named = names.select(F.col("id").alias("cause"), "name")
    pieces = stored(known.join(named, "cause").select("root", "cause", "depth", "via", F.col("via").alias("top"), F.array("name").alias("nodes")))
    done = None
    while not pieces.isEmpty():
        whole = pieces.where("top = root")
        done = whole if done is None else done.unionByName(whole)
        front = (whole if done is whole else done).unionByName(pieces.where("top <> root")).select(
            "root", F.col("cause").alias("top"), F.col("top").alias("upper"), F.col("nodes").alias("front"))
        open_ = pieces.where("top <> root")
        pieces = stored(open_.join(front, ["root", "top"]).select("root", "cause", "depth", "via", F.col("upper").alias("top"),
                                                                    F.concat("front", "nodes").alias("nodes")))
    if done is None:
        done = pieces
    roots, vias = (names.select(F.col("id").alias(i), F.col("name").alias(c)) for i, c in (("root", "_root"), ("via", "_via")))
    done = done.join(roots, "root").join(vias, "via")
    path = F.array_join(F.concat(F.array("_root"), F.col("nodes")), " -> ")
    return done.select(F.col("_root").alias("root"), F.element_at("nodes", -1).alias("cause"), "depth", F.col("_via").alias("via"), path.alias("path"))


def causal_chain(spark: SparkSession, evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """Chains symptom -> cause -> cause ... from each observed class, the shortest to every cause.

    The rule table is closed once (``close_rules``) and joined to the observed classes, so the closure's
    size depends on the rules alone, not on the number of cases."""
    obs = evidence.select("case_id", F.col("pattern").alias("root")).distinct()
    return obs.join(close_rules(rules), "root").select("case_id", "root", "cause", "depth", "path")


def report_evidence(cases: DataFrame, evidence: DataFrame, top_n: int = 5) -> DataFrame:
    """Evidence rows for each case's report: the claimed keys found, in claim
    order; if none of them exists, all evidence by count; with no claimed key
    the top ``top_n`` by count."""
    from pyspark.sql import Window
    cl = claims(cases)
    ev = evidence.select("case_id", "pattern", "count")
    matched = (cl.join(ev.withColumnRenamed("pattern", "key"), ["case_id", "key"])
               .select("case_id", F.col("key").alias("pattern"), "count",
                       F.col("pos").alias("_o")))
    has_claims = cases.where(F.size(F.coalesce("key_evidence", F.array())) > 0).select("case_id")
    no_match = has_claims.join(matched.select("case_id").distinct(), "case_id", "left_anti")
    no_claims = cases.where(F.size(F.coalesce("key_evidence", F.array())) == 0).select("case_id")
    w = Window.partitionBy("case_id").orderBy(F.desc("count"), "pattern")
    ranked = ev.withColumn("_o", F.row_number().over(w) - 1)
    all_by_count = ranked.join(no_match, "case_id", "left_semi")
    top = ranked.where(F.col("_o") < top_n).join(no_claims, "case_id", "left_semi")
    out = matched.unionByName(all_by_count).unionByName(top)
    return out.select("case_id", (F.col("_o") + 1).cast("bigint").alias("pos"), "pattern", "count")
