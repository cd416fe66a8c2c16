"""Evidence maps: hit lines folded into one row per pattern.

An evidence row is ``pattern, count, timestamps, files, sample_lines,
variables`` (+ exact distinct counts ``n_timestamps``, ``n_files``,
``n_variables``). Two keyings exist: by error class (multi-label, nine
classes) and by normalised message template.

Plan shape (one pass over the hits, whatever the key skew):

1. every hit line is turned into a handful of *facts* ``(pattern, field,
   value, ord)``: its timestamp, its file, each variable, a line counter;
2. ``groupBy(pattern, field, value)`` with partial aggregation: duplicates
   collapse map-side, a hot pattern is still spread over reducers by value;
3. ``row_number() <= k`` per (pattern, field): Spark plans a partial
   WindowGroupLimit before the shuffle, so at most k rows per pattern and
   map task travel;
4. the short lists and counters are joined on ``pattern``.

Lists are bounded views (``k`` per field; ``None``: every value); distinct counts stay exact.
``evidence_facts`` is the whole result behind them: a long table with every
timestamp, file and variable of every pattern. Arrival order is
(path, line_no[, position in line]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

EVIDENCE_FIELDS = ["timestamps", "files", "sample_lines", "variables"]

# field name -> (short fact tag)
_TAG = {"timestamps": "ts", "files": "file", "sample_lines": "sample", "variables": "var"}
#: Line numbers of a path whose values are sorted as one piece of a whole list.
_PIECE = 1 << 16


def _ord(idx: Column | None = None) -> Column:
    return F.struct(F.col("path").alias("p"), F.col("line_no").alias("l"),
                    (idx if idx is not None else F.lit(0)).cast("int").alias("i"))


def _fact(tag: str, value: Column, idx: Column | None = None) -> Column:
    return F.struct(F.lit(tag).alias("f"), value.cast("string").alias("v"),
                    _ord(idx).alias("o"))


def _facts(keyed: DataFrame, items: list[Column], keep: Column | None = None) -> DataFrame:
    """keyed has ``pattern``; items are ARRAY<STRUCT<f,v,o>> columns.

    Rows failing ``keep`` yield no facts: dropping them through the
    generator (not a Filter) keeps Catalyst from pushing the expensive key
    expression below a shuffle and evaluating it twice."""
    arr = F.concat(*items)
    if keep is not None:
        arr = F.when(keep, arr)
    return (keyed.select("pattern", F.explode(arr).alias("x"))
            .select("pattern", "x.f", "x.v", "x.o")
            .where(F.col("v").isNotNull() & (F.col("v") != "") | (F.col("f") == "_n")))


def _distinct_facts(facts: DataFrame, keep_dups: tuple[str, ...] = ()) -> DataFrame:
    """One row per (pattern, field, value): first arrival and multiplicity.

    Fields in ``keep_dups`` keep every occurrence (their arrival is part of
    the group key)."""
    dup_key = F.when(F.col("f").isin(list(keep_dups)), F.col("o")) if keep_dups \
        else F.lit(None)
    return (facts.groupBy("pattern", "f", "v", dup_key.alias("_d"))
            .agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("n"))
            .drop("_d"))


def _first_k(distinct: DataFrame, spec: dict[str, tuple[int | None, str]]) -> DataFrame:
    """First ``k`` values per (pattern, field): ``spec[field] = (k, order)``,
    order ``"value"`` (sorted) or ``"arrival"``; all of them, by arrival, where k is None.
    Returns one row per pattern with an ARRAY<STRING> per field."""
    whole = [name for name, (k, _) in spec.items() if k is None]
    if whole:
        some = {name: x for name, x in spec.items() if name not in whole}
        every = _every_value(distinct, whole)
        # "f" by way of "n": a filter on it then stays above the shared exchange
        held = distinct.withColumn("f", F.when(F.col("n") > 0, F.col("f")))
        return every.join(_first_k(held, some), "pattern", "full_outer") if some else every
    tags = {_TAG[name]: (name, k, order) for name, (k, order) in spec.items()}
    kmax = max(k for _, k, _ in tags.values())
    by_value = [t for t, (_, _, order) in tags.items() if order == "value"]
    k_of = F.create_map(*[x for t, (_, k, _) in tags.items() for x in (F.lit(t), F.lit(k))])
    sort_v = F.when(F.col("f").isin(by_value), F.col("v"))
    # "n" as last tie-break keeps every column of `distinct` in use, so this
    # branch and _counters read one shared (reused) exchange
    w = Window.partitionBy("pattern", "f").orderBy(sort_v.asc_nulls_last(), "o", "v", "n")
    ranked = (distinct.where(F.col("f").isin(list(tags)))
              .withColumn("rn", F.row_number().over(w))
              .where(F.col("rn") <= kmax)            # literal bound: WindowGroupLimit
              .where(F.col("rn") <= k_of[F.col("f")]))
    aggs = [F.transform(F.array_sort(F.collect_list(
                F.when(F.col("f") == t, F.struct("rn", "v")))), lambda x: x["v"]).alias(name)
            for t, (name, _, _) in tags.items()]
    return ranked.groupBy("pattern").agg(*aggs)


def _every_value(distinct: DataFrame, names: list[str]) -> DataFrame:
    """One row per pattern with all values of each field by arrival.

    Values are sorted in pieces of a path's ``_PIECE`` line numbers, spread over reducers; a pattern's
    list is its pieces put one behind the other. Fields without a list here give empty pieces: no filter
    on ``f``, so the exchange stays the shared one."""
    tags = [_TAG[name] for name in names]
    value = F.when(F.col("f").isin(tags), F.struct(F.col("o.l").alias("l"), F.col("o.i").alias("i"), "v", "n"))
    pieces = (distinct.groupBy("pattern", "f", F.col("o.p").alias("p"), F.floor(F.col("o.l") / _PIECE).alias("c"))
              .agg(F.transform(F.sort_array(F.collect_list(value)), lambda x: x["v"]).alias("vs")).where(F.size("vs") > 0))
    aggs = [F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("f") == tag, F.struct("p", "c", "vs")))),
                                  lambda x: x["vs"])).alias(name) for name, tag in zip(names, tags)]
    return pieces.groupBy("pattern").agg(*aggs)


def _counters(distinct: DataFrame, fields: list[str]) -> DataFrame:
    # every column of `distinct` is read here (count(v), min(o), sum(n)) just
    # as in _first_k, so both branches share one exchange (ReusedExchange)
    is_n = F.col("f") == "_n"
    aggs = [F.sum(F.when(is_n, F.col("n"))).cast("bigint").alias("count"),
            F.min(F.when(is_n, F.col("o"))).alias("first_seen")]
    aggs += [F.count(F.when(F.col("f") == _TAG[f], F.col("v"))).cast("bigint").alias("n_" + f)
             for f in fields]
    return distinct.groupBy("pattern").agg(*aggs)


def _fill_lists(df: DataFrame, names: list[str]) -> DataFrame:
    empty = F.array().cast("array<string>")
    return df.select(*[F.coalesce(F.col(c), empty).alias(c) if c in names else F.col(c)
                       for c in df.columns])


def _first_rows(keyed: DataFrame, k: int) -> DataFrame:
    """First ``k`` hit lines per pattern in arrival order, repeats kept."""
    w = Window.partitionBy("pattern").orderBy("path", "line_no")
    return (keyed.select("pattern", "path", "line_no", "line_text")
            .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
            .groupBy("pattern")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line_text"))),
                             lambda x: x["line_text"]).alias("sample_lines")))


def evidence_by_class(hits: DataFrame, *, ts_k: int = 10, files_k: int = 5,
                      samples_k: int = 3, vars_k: int = 10) -> DataFrame:
    """Class-keyed evidence map (nine classes, a line may have several).

    timestamps: short timestamps, distinct, sorted, first ``ts_k``;
    files: distinct, first ``files_k`` by name; sample_lines: first
    ``samples_k`` lines (repeats kept); variables: typed variables, distinct,
    first ``vars_k`` by value. Lines with no class are dropped.
    """
    keyed = hits.select("path", "line_no", "line_text",
                        F.explode(T.class_labels("line_text")).alias("pattern"))
    line = F.col("line_text")
    facts = _facts(keyed, [
        F.array(_fact("_n", F.lit("")), _fact("ts", T.extract_short_ts(line)),
                _fact("file", F.col("path"))),
        F.transform(T.typed_variables(line), lambda x, i: _fact("var", x, i)),
    ])
    distinct = _distinct_facts(facts)
    lists = _first_k(distinct, {"timestamps": (ts_k, "value"), "files": (files_k, "value"),
                                "variables": (vars_k, "value")})
    out = (_counters(distinct, ["timestamps", "files", "variables"])
           .join(lists, "pattern", "left")
           .join(_first_rows(keyed, samples_k), "pattern", "left"))
    return _fill_lists(out, EVIDENCE_FIELDS).select(
        "pattern", "count", *EVIDENCE_FIELDS, "n_timestamps", "n_files", "n_variables",
        F.col("first_seen.p").alias("first_path"), F.col("first_seen.l").alias("first_line_no"))


def evidence_by_template(hits: DataFrame, *, strip_prefix: bool = True, ts_k: int | None = 10,
                         files_k: int | None = 5, samples_k: int | None = 3,
                         vars_k: int | None = 20) -> DataFrame:
    """Template-keyed evidence map (one key per normalised message).

    Blank lines and empty keys are skipped. timestamps, files, sample_lines
    and variables are distinct and kept in arrival order, the first ``k`` of
    each, or all (None); variables are the strings the normalising rewrites
    remove from the whole line.
    """
    line = F.col("line_text")
    keyed = (hits.where(T.py_strip(line) != "")
             .select("path", "line_no", "line_text",
                     T.error_pattern(line, strip_prefix=strip_prefix).alias("pattern")))
    facts = _facts(keyed, [
        F.array(_fact("_n", F.lit("")), _fact("ts", T.extract_timestamp(line)),
                _fact("file", F.col("path")), _fact("sample", line)),
        F.transform(T.extract_variables(line), lambda x, i: _fact("var", x, i)),
    ], keep=F.col("pattern") != "")
    distinct = _distinct_facts(facts)
    lists = _first_k(distinct, {"timestamps": (ts_k, "arrival"),
                                "files": (files_k, "arrival"),
                                "sample_lines": (samples_k, "arrival"),
                                "variables": (vars_k, "arrival")})
    out = (_counters(distinct, ["timestamps", "files", "variables"])
           .join(lists, "pattern", "left"))
    return _fill_lists(out, EVIDENCE_FIELDS).select(
        "pattern", "count", *EVIDENCE_FIELDS, "n_timestamps", "n_files", "n_variables",
        F.col("first_seen.p").alias("first_path"), F.col("first_seen.l").alias("first_line_no"))


def evidence_facts(hits: DataFrame, *, strip_prefix: bool = True) -> DataFrame:
    """Whole template evidence as a long table, nothing capped.

    One row per (pattern, field, value): how often it occurs (``n``) and where
    first. ``field`` is ``lines`` (value empty, ``n`` the pattern's count),
    ``timestamps``, ``files`` or ``variables``. A pattern's values are rows,
    not one list, so a pattern of any size stays spread over reducers. Lines
    themselves are not shuffled.
    """
    line = F.col("line_text")
    keyed = (hits.where(T.py_strip(line) != "")
             .select("path", "line_no", "line_text",
                     T.error_pattern(line, strip_prefix=strip_prefix).alias("pattern")))
    facts = _facts(keyed, [
        F.array(_fact("_n", F.lit("")), _fact("ts", T.extract_timestamp(line)),
                _fact("file", F.col("path"))),
        F.transform(T.extract_variables(line), lambda x, i: _fact("var", x, i)),
    ], keep=F.col("pattern") != "")
    names = {tag: name for name, tag in _TAG.items()} | {"_n": "lines"}
    field = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("f")]
    return _distinct_facts(facts).select(
        "pattern", field.alias("field"), F.col("v").alias("value"), "n",
        F.col("o.p").alias("first_path"), F.col("o.l").alias("first_line_no"))


FACT_KEYS = ["pattern", "field", "value"]


def merge_facts(facts: DataFrame) -> DataFrame:
    """A union of ``evidence_facts`` tables as one: counts are added, the first place stays.

    One shuffle, on the whole key, with partial sums in front of it; associative, so parts can be
    merged in any order and grouping."""
    place = F.struct("first_path", "first_line_no")
    return (facts.groupBy(*FACT_KEYS).agg(F.sum("n").alias("n"), F.min(place).alias("_first"))
            .select(*FACT_KEYS, "n", "_first.first_path", "_first.first_line_no"))


def facts_stats(facts: DataFrame) -> DataFrame:
    """The columns of ``evidence_stats`` over an ``evidence_facts`` table: all
    files of all patterns are counted, however many a pattern has."""
    is_line = F.col("field") == "lines"
    total = F.coalesce(F.col("o"), F.lit(0))
    return (facts.agg(F.count_if(is_line).alias("p"),
                      F.sum(F.when(is_line, F.col("n"))).alias("o"),
                      F.count_distinct(F.when(F.col("field") == "files", F.col("value"))).alias("f"))
            .select(F.col("p").cast("bigint").alias("total_unique_patterns"),
                    total.cast("bigint").alias("total_occurrences"),
                    F.col("f").cast("bigint").alias("total_files"),
                    F.when(F.col("p") > 0, F.floor(total / F.col("p")))
                    .otherwise(0).cast("bigint").alias("avg_occurrences_per_pattern")))


def evidence_from_searches(hit_sets: list[DataFrame], strip_prefix: bool = True) -> DataFrame:
    """Template evidence over several (overlapping) searches: the hit sets
    are unioned and a line counts once (``dropDuplicates`` on path and line
    number, a shuffle on a unique key, so no skew), instead of inflating
    counts on every re-search."""
    hits = hit_sets[0].select("path", "line_no", "line_text")
    for h in hit_sets[1:]:
        hits = hits.unionByName(h.select("path", "line_no", "line_text"))
    return evidence_by_template(hits.dropDuplicates(["path", "line_no"]), strip_prefix=strip_prefix)


def evidence_merge(*maps: DataFrame, ts_k: int = 10, files_k: int = 5,
                   samples_k: int = 3, vars_k: int = 10) -> DataFrame:
    """Merge evidence maps (associative, so usable incrementally).

    count: sum; timestamps: union, sorted, first ``ts_k``; files and
    variables: union, first ``files_k`` / ``vars_k`` by value; sample_lines:
    the maps' samples in map order, first ``samples_k`` (repeats kept).
    """
    parts = []
    for seq, m in enumerate(maps):
        parts.append(m.select(
            "pattern", F.lit(seq).alias("path"), F.col("count").alias("_c"),
            *[F.col(f) for f in EVIDENCE_FIELDS]))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.withColumn("line_no", F.lit(0).cast("bigint"))
    items = [F.array(F.struct(F.lit("_n").alias("f"), F.col("_c").cast("string").alias("v"),
                              _ord().alias("o")))]
    def tagger(tag):
        return lambda x, i: _fact(tag, x, i)
    for name in EVIDENCE_FIELDS:
        items.append(F.transform(F.col(name), tagger(_TAG[name])))
    facts = _facts(u, items)
    counts = (facts.where(F.col("f") == "_n").groupBy("pattern")
              .agg(F.sum(F.col("v").cast("bigint")).alias("count")))
    distinct = _distinct_facts(facts.where(F.col("f") != "_n"), keep_dups=("sample",))
    lists = _first_k(distinct, {"timestamps": (ts_k, "value"), "files": (files_k, "value"),
                                "sample_lines": (samples_k, "arrival"),
                                "variables": (vars_k, "value")})
    out = counts.join(lists, "pattern", "left")
    return _fill_lists(out, EVIDENCE_FIELDS).select("pattern", "count", *EVIDENCE_FIELDS)


def evidence_stats(ev: DataFrame) -> DataFrame:
    """total_unique_patterns, total_occurrences, total_files (distinct files
    listed in the map; ``facts_stats`` counts all), avg_occurrences_per_pattern
    (floor); zeros on an empty map. One aggregate: files are exploded, the count is taken once per
    pattern (position 0 or no file)."""
    x = ev.select("pattern", "count", F.posexplode_outer("files").alias("pos", "path"))
    first = F.col("pos").isNull() | (F.col("pos") == 0)
    return (x.agg(F.count_if(first).alias("p"),
                  F.sum(F.when(first, F.col("count"))).alias("o"),
                  F.count_distinct("path").alias("f"))
            .select(F.col("p").cast("bigint").alias("total_unique_patterns"),
                    F.coalesce(F.col("o"), F.lit(0)).cast("bigint").alias("total_occurrences"),
                    F.col("f").cast("bigint").alias("total_files"),
                    F.when(F.col("p") > 0, F.floor(F.coalesce(F.col("o"), F.lit(0)) / F.col("p")))
                    .otherwise(0).cast("bigint").alias("avg_occurrences_per_pattern")))


def evidence_totals(hits: DataFrame) -> DataFrame:
    """label_matches (sum of class counts, as the original tool reports it),
    line_matches (hit lines with at least one class), patterns_found
    (sorted). One aggregate over the hits."""
    labels = T.class_labels("line_text")
    return (hits.select(labels.alias("l"))
            .agg(F.sum(F.size("l")).cast("bigint").alias("label_matches"),
                 F.count_if(F.size("l") > 0).cast("bigint").alias("line_matches"),
                 F.collect_set("l").alias("_s"))
            .select(F.coalesce("label_matches", F.lit(0)).cast("bigint").alias("label_matches"),
                    "line_matches",
                    F.array_sort(F.array_distinct(F.flatten("_s"))).alias("patterns_found")))


def evidence_top(ev: DataFrame, k: int = 50) -> DataFrame:
    """Patterns by count descending (ties by pattern), first ``k``, with rank
    and the number of patterns left out. TakeOrderedAndProject keeps k rows
    per task; the rank window then sees at most k rows."""
    total = ev.agg(F.count(F.lit(1))).scalar()
    top = ev.orderBy(F.desc("count"), "pattern").limit(k)
    w = Window.orderBy(F.desc("count"), "pattern")
    return (top.withColumn("rank", F.row_number().over(w))
            .withColumn("more_patterns", F.greatest(total - k, F.lit(0)).cast("bigint")))
