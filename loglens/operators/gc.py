"""GC log analytics: parse lines into typed events, intervals, statistics,
per-executor health, configuration, sorted and top-n tables.

Parsing is a narrow projection (regexes in the JVM). Statistics are single
partial/final aggregates; per-executor work is a ``groupBy`` whose
aggregates are all algebraic, so a hot executor is combined map-side.
Intervals need a global order: see :mod:`loglens.operators.ordered`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gcparse as G
from ..functions import patterns as P
from . import ordered as O

GC_COLUMNS = ["event", "event_id", "timestamp_s", "duration_ms", "mem_before_str",
              "mem_after_str", "heap_str", "mem_before_bytes", "mem_after_bytes",
              "heap_bytes", "freed_bytes", "freed_mb_str", "freed_pct", "kind",
              "kind_short", "stw", "full", "cause", "path", "service", "line_no"]


def gc_parse(lines: DataFrame, text_col: str = "line_text",
             prefilter: str | None = None) -> DataFrame:
    """Lines -> GC events (one per matching line; other lines are dropped).

    ``lines`` has ``path`` (nullable), ``line_no`` and the text. Missing
    values are NULL (the original used -1 / ``?`` sentinels; the display
    columns keep ``?``). ``prefilter`` is an optional literal such as
    ``"Full GC"`` applied before the regexes (case-sensitive).
    """
    line = F.col(text_col)
    src = lines.where(line.contains(prefilter)) if prefilter else lines
    # Each regex result is materialised by one Project and tested in the
    # next (Catalyst does not collapse projects that would duplicate it), and
    # a shape is tried only where the earlier ones failed.
    L = F.col("_l")
    pk = G.gc_packed(L)

    def matched(col: str) -> Column:
        return F.when(F.col(col) != L, F.col(col))

    x = src.select("path", "line_no", line.alias("_l")).select("*", pk["A"].alias("_ra"))
    x = x.select("path", "line_no", "_l", matched("_ra").alias("_a"))
    x = x.select("*", F.when(F.col("_a").isNull(), pk["B"]).alias("_rb"))
    x = x.select("path", "line_no", "_l", "_a", matched("_rb").alias("_b"))
    x = x.select("*", F.when(F.col("_a").isNull() & F.col("_b").isNull(), pk["C"]).alias("_rc"))
    x = x.select("path", "line_no", "_a", "_b", matched("_rc").alias("_c"))
    # lines without a shape drop out through the generator (a filter here
    # would be pushed below the projects and evaluate the regexes again)
    hit = F.coalesce(F.col("_a"), F.col("_b"), F.col("_c"))
    m = x.select("path", "line_no", F.explode(F.when(hit.isNotNull(), F.array(
        F.split(hit, G.SEP)))).alias("_g"))
    m = m.select("path", "line_no", *[F.nullif(F.element_at(F.col("_g"), i + 1), F.lit("")).alias(f"_{f}")
                                      for i, f in enumerate(G.GC_FIELDS)])
    g = {f: F.col(f"_{f}") for f in G.GC_FIELDS}
    # normalised size strings and description first, so the parsers below
    # read plain columns (small generated code, one evaluation each)
    m = m.select("path", "line_no", "_event", "_id", "_ts", "_dur", "_before", "_after", "_heap",
                 G.size_norm(g["before"]).alias("_b2"), G.size_norm(g["after"]).alias("_a2"),
                 G.size_norm(g["heap"]).alias("_h2"),
                 G.py_strip(F.coalesce(g["desc"], F.lit(""))).alias("_desc"))
    m = m.select("*", F.lower("_desc").alias("_low"))
    x = m.select(
        "path", "line_no", "_desc",
        F.col("_event").alias("event"),
        F.col("_id").try_cast("bigint").alias("event_id"),
        F.col("_ts").try_cast("double").alias("timestamp_s"),
        G.duration_ms(F.col("_dur")).alias("duration_ms"),
        F.coalesce(F.col("_before"), F.lit("?")).alias("mem_before_str"),
        F.coalesce(F.col("_after"), F.lit("?")).alias("mem_after_str"),
        F.coalesce(F.col("_heap"), F.lit("?")).alias("heap_str"),
        G.size_from_norm(F.col("_b2")).alias("mem_before_bytes"),
        G.size_from_norm(F.col("_a2")).alias("mem_after_bytes"),
        G.size_from_norm(F.col("_h2")).alias("heap_bytes"),
        G.gc_kind_of(F.col("_low")).alias("kind"))
    freed = F.when((F.col("mem_before_bytes") >= 0) & (F.col("mem_after_bytes") >= 0),
                   F.col("mem_before_bytes") - F.col("mem_after_bytes"))
    k = G.gc_kind_attrs(F.col("kind"), F.col("_desc"))
    x = x.select(
        "*", freed.alias("freed_bytes"),
        k["kind_short"].alias("kind_short"),
        k["stw"].alias("stw"), k["full"].alias("full"), k["cause"].alias("cause"),
        G.service_from_path(F.col("path")).alias("service"))
    x = x.select(
        "*", G.bytes_to_mb(F.col("freed_bytes")).alias("freed_mb_str"),
        F.when((F.col("freed_bytes") >= 0) & (F.col("heap_bytes") > 0),
               F.col("freed_bytes") / F.col("heap_bytes")).alias("freed_pct"))
    return x.select(*GC_COLUMNS)


def _service_major_order() -> list[Column]:
    return [F.coalesce(F.col("service"), F.lit("")), F.col("timestamp_s"),
            F.coalesce(F.col("event_id"), F.lit(0)), F.coalesce(F.col("path"), F.lit("")),
            F.coalesce(F.col("line_no"), F.lit(0))]


def gc_compat(events: DataFrame) -> DataFrame:
    """The original row encoding: missing numbers as -1 / -1.0 sentinels
    instead of NULL (display strings already carry ``?``)."""
    minus1 = {"duration_ms": -1.0, "timestamp_s": -1.0, "freed_pct": -1.0,
              "mem_before_bytes": -1, "mem_after_bytes": -1, "heap_bytes": -1, "freed_bytes": -1}
    return events.select(*[F.coalesce(F.col(c), F.lit(minus1[c])).alias(c) if c in minus1
                           else F.col(c) for c in events.columns])


def _time_major_order() -> list[Column]:
    return [F.col("timestamp_s"), F.coalesce(F.col("service"), F.lit("")),
            F.coalesce(F.col("event_id"), F.lit(0)), F.coalesce(F.col("path"), F.lit("")),
            F.coalesce(F.col("line_no"), F.lit(0))]


def gc_with_intervals(events: DataFrame, slices: int | None = None,
                      global_order: str = "service") -> DataFrame:
    """Add ``interval_prev_s`` (previous event in service-major order, so it
    crosses services) and ``interval_prev_service_s`` (previous event of the
    same service; NULL service is a group of its own).

    Both use one range partitioning on (service, ts, event_id, path,
    line_no); no task ever holds more than one slice of the order.
    ``global_order="time"`` orders the global interval by time first (the
    per-service interval is the same either way).
    """
    order = _time_major_order() if global_order == "time" else _service_major_order()
    x = O.slice_by_order(events.withColumn("_grp", F.coalesce(F.col("service"), F.lit("_"))),
                         order, slices)
    x = O.lag_in_order(x, "timestamp_s", "_prev_g")
    x = O.lag_in_order(x, "timestamp_s", "_prev_s", group="_grp")
    x = (x.withColumn("interval_prev_s", F.col("timestamp_s") - F.col("_prev_g"))
         .withColumn("interval_prev_service_s", F.col("timestamp_s") - F.col("_prev_s")))
    return O.drop_order_cols(x).drop("_grp", "_prev_g", "_prev_s")


def gc_filter(events: DataFrame, min_duration_ms: float = 0.0,
              only_stw: bool = False) -> DataFrame:
    out = events
    if min_duration_ms and min_duration_ms > 0:
        out = out.where(F.col("duration_ms") >= F.lit(float(min_duration_ms)))
    if only_stw:
        out = out.where(F.col("stw"))
    return out


def gc_driver_events(events: DataFrame) -> DataFrame:
    return events.where(F.lower(F.coalesce(F.col("path"), F.lit("None"))).contains("driver"))


# ------------------------------------------------------------- statistics --
def _stw_dur() -> Column:
    return F.when(F.col("stw") & (F.col("duration_ms") >= 0), F.col("duration_ms"))


def gc_stats(events: DataFrame, slices: int | None = None, percentiles: bool = True) -> DataFrame:
    """All counters, pause moments, freed totals, observed span and event rate
    in one algebraic aggregate; the percentiles (exact, linear between closest
    ranks) come from :func:`gc_pause_percentiles`, so no task holds all pauses.
    Without ``percentiles`` those columns are absent, and the events are read once."""
    d = _stw_dur()
    fr = F.when(F.col("freed_bytes") >= 0, F.col("freed_bytes"))
    ts = F.when(F.col("timestamp_s") >= 0, F.col("timestamp_s"))
    pcts = gc_pause_percentiles(events, slices=slices).select(F.struct("*")).scalar() if percentiles else F.lit(None)
    a = events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("stw")).alias("stw_events"),
        F.count_if(F.col("kind") == "concurrent").alias("concurrent_events"),
        F.count_if(F.col("kind") == "pause_young").alias("young_gc"),
        F.count_if(F.col("full")).alias("full_gc"),
        F.count_if(F.col("kind") == "remark").alias("remark"),
        F.count_if(F.col("kind") == "cleanup").alias("cleanup"),
        F.coalesce(F.sum(d), F.lit(0.0)).alias("total_stw_pause_ms"),
        F.avg(d).alias("avg_pause_ms"),
        (F.coalesce(F.sum(fr), F.lit(0)) / 1048576.0).alias("total_freed_mb"),
        (F.max(fr) / 1048576.0).alias("max_freed_mb"),
        F.max(d).alias("max_pause_ms"),
        F.count(ts).alias("_nts"), F.min(ts).alias("_min"), F.max(ts).alias("_max"))
    span = F.when(F.col("_nts") >= 2, F.col("_max") - F.col("_min"))
    return a.withColumn("_p", pcts).select(
        *[F.col(c).cast("bigint").alias(c) for c in
          ("total_events", "stw_events", "concurrent_events", "young_gc", "full_gc",
           "remark", "cleanup")],
        "total_stw_pause_ms", "avg_pause_ms",
        *(["_p.p50_pause_ms", "_p.p95_pause_ms", "_p.p99_pause_ms"] if percentiles else []),
        "total_freed_mb", "max_freed_mb", "max_pause_ms",
        span.alias("observed_span_s"),
        F.when(span > 0, F.col("total_events") / span * 60.0).alias("events_per_min"))


def gc_pause_percentiles(events: DataFrame, ps=(0.5, 0.95, 0.99),
                         slices: int | None = None) -> DataFrame:
    """p50/p95/p99 of stop-the-world pauses with a known duration, exact and
    without a single task holding every value (rank-based, see
    :func:`loglens.operators.ordered.rank_percentiles`)."""
    names = [f"p{int(round(p * 100))}_pause_ms" for p in ps]
    r = O.rank_percentiles(events.select(_stw_dur().alias("d")), "d", list(ps), slices)
    return r.select(*[F.col(f"p{i}").alias(n) for i, n in enumerate(names)])


def sketch_rank_error(k: int) -> float:
    """How far the rank of a sketch's quantile may lie from the one asked for, as a share of all values, with
    99 % confidence (the published error of KLL sketches: 1.33 % at k = 200)."""
    return 2.296 / k ** 0.9723


def gc_pause_sketches(events: DataFrame, window_s: float = 3600.0, k: int = 200) -> DataFrame:
    """(executor_ip, window_start_s, n, sketch): a KLL sketch of the stop-the-world pauses of each executor and window.

    Sketches of any windows and runs can be kept and merged (:func:`merge_sketches`); a sketch has a few
    kilobytes, whatever it holds. Percentiles of one run stay exact in :func:`gc_pause_percentiles`.
    """
    start = F.floor(F.col("timestamp_s") / F.lit(float(window_s))) * F.lit(float(window_s))
    pauses = events.select(G.executor_from_path(F.col("path")).alias("executor_ip"), start.alias("window_start_s"), _stw_dur().alias("_d"))
    return (pauses.where("_d IS NOT NULL").groupBy("executor_ip", "window_start_s")
            .agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_d", F.lit(k)).alias("sketch")))


def merge_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches merged by some of their columns (none: all into one); associative."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, ps=(0.5, 0.95, 0.99)) -> DataFrame:
    """The sketches' other columns and a column ``p<percent>`` for each quantile."""
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"p{round(p * 100)}") for p in ps])


def gc_by_executor(events: DataFrame, compat_ip: bool = False) -> DataFrame:
    """Per executor (IP from the path; ``driver`` / ``unknown`` otherwise):
    event counts, max/avg duration, max heap use after GC, health status and
    issues."""
    dur = F.when(F.col("duration_ms") >= 0, F.col("duration_ms"))
    heap_pct = F.when((F.col("heap_bytes") > 0) & (F.col("mem_after_bytes") >= 0),
                      F.col("mem_after_bytes") / F.col("heap_bytes") * 100.0)
    after = F.when(F.col("mem_after_bytes") >= 0, F.col("mem_after_bytes"))
    a = (events.withColumn("executor_ip", G.executor_from_path(F.col("path"), compat_ip))
         .groupBy("executor_ip")
         .agg(F.count(F.lit(1)).cast("bigint").alias("total_events"),
              F.count_if(F.col("full")).cast("bigint").alias("full_gc_count"),
              F.count_if(F.col("kind") == "pause_young").cast("bigint").alias("young_gc_count"),
              F.coalesce(F.max(dur), F.lit(0.0)).alias("max_duration_ms"),
              F.coalesce(F.avg(dur), F.lit(0.0)).alias("avg_duration_ms"),
              F.coalesce(F.max(heap_pct), F.lit(0.0)).alias("max_heap_used_pct"),
              F.coalesce(F.max(after), F.lit(0)).cast("bigint").alias("max_heap_used_bytes")))
    a = a.withColumn("max_duration_sec",
                     F.when(F.col("max_duration_ms") > 0, F.col("max_duration_ms") / 1000.0)
                     .otherwise(0.0))
    return gc_health(a)


def gc_health(agg: DataFrame) -> DataFrame:
    """Health status and issue list from full-GC count, longest pause and
    highest heap use (rules applied in the original order)."""
    full, mx, hp = F.col("full_gc_count"), F.col("max_duration_ms"), F.col("max_heap_used_pct")
    base = (F.when(full >= P.HEALTH_FULL_HEAVY, F.lit(P.STATUS_HEAVY))
            .when(full >= P.HEALTH_FULL_MODERATE, F.lit(P.STATUS_MODERATE))
            .otherwise(F.lit(P.STATUS_HEALTHY)))
    lifted = F.when(((mx >= P.HEALTH_LONG_PAUSE_MS) | (hp >= P.HEALTH_HEAP_PCT))
                    & (base == P.STATUS_HEALTHY), F.lit(P.STATUS_HEAVY)).otherwise(base)
    issues = F.array_compact(F.array(
        F.when(full >= P.HEALTH_FULL_HEAVY, F.lit(P.ISSUE_EXCESSIVE_FULL))
        .when(full >= P.HEALTH_FULL_MODERATE, F.lit(P.ISSUE_HIGH_FULL)),
        F.when(mx >= P.HEALTH_LONG_PAUSE_MS, G.py_format(P.ISSUE_LONG_PAUSE, mx / 1000.0)),
        F.when(hp >= P.HEALTH_HEAP_PCT, G.py_format(P.ISSUE_HEAP_PRESSURE, hp))))
    return agg.withColumn("health_status", lifted).withColumn("health_issues", issues)


def gc_executor_ranking(by_exec: DataFrame) -> DataFrame:
    """Executors (driver and unknown excluded) by full GCs, most first."""
    return (by_exec.where(~F.col("executor_ip").isin("driver", "unknown"))
            .orderBy(F.desc("full_gc_count"), "executor_ip"))


def gc_config(lines: DataFrame, text_col: str = "line_text") -> DataFrame:
    """(parameter, value) rows: Max Heap Size (first ``-Xmx`` in G or M,
    else the largest ``(size)`` seen) and GC Algorithm (G1 > Parallel > CMS).
    Whole-corpus aggregate, one pass, partial aggregation."""
    t = F.col(text_col)
    xmx_rx = r"-Xmx([\d\.]+)([GMK])"
    pos = F.struct(F.coalesce(F.col("path"), F.lit("")), F.col("line_no"))
    sizes = F.transform(F.regexp_extract_all(t, F.lit(r"\((\d+(?:\.\d+)?[KMGT])\)"), 1),
                        lambda s: G.size_to_bytes(s))
    algo_flags = [F.max(F.when(
        _any_contains(t, markers), F.lit(1)).otherwise(0)).alias(f"_a{i}")
        for i, (_, markers) in enumerate(P.GC_ALGORITHMS)]
    a = lines.agg(
        F.min_by(F.struct(F.regexp_extract(t, xmx_rx, 1).alias("n"),
                          F.regexp_extract(t, xmx_rx, 2).alias("u")),
                 F.when(t.rlike(xmx_rx), pos)).alias("_x"),
        F.max(F.array_max(sizes)).alias("_maxheap"),
        *algo_flags)
    n, u = F.col("_x.n"), F.col("_x.u")
    val = n.try_cast("double")
    xmx_head, xmx_tail = P.CONFIG_XMX_FORMAT.split("{value}")
    xmx_mid, xmx_end = xmx_tail.split("{arg}")
    obs_tail = P.CONFIG_OBSERVED_FORMAT.split("{value}")[1]

    def xmx_text(v: Column) -> Column:
        return F.concat(F.lit(xmx_head), v, F.lit(xmx_mid), n, u, F.lit(xmx_end))
    xmx = (F.when(u == "G", xmx_text(val.cast("string")))
           .when(u == "M", xmx_text(G.fmt_fixed(val / 1024.0, 1))))
    observed = F.when(F.col("_maxheap") > 0, F.concat(
        G.fmt_fixed(F.col("_maxheap") / 1073741824.0, 1), F.lit(obs_tail)))
    algo = None
    for i, (name, _) in enumerate(P.GC_ALGORITHMS):
        cond = F.col(f"_a{i}") == 1
        algo = F.when(cond, F.lit(name)) if algo is None else algo.when(cond, F.lit(name))
    rows = F.array(
        F.struct(F.lit(1).alias("ord"), F.lit(P.CONFIG_MAX_HEAP).alias("parameter"),
                 F.coalesce(xmx, observed).alias("value")),
        F.struct(F.lit(2).alias("ord"), F.lit(P.CONFIG_ALGORITHM).alias("parameter"),
                 algo.alias("value")))
    return (a.select(F.inline(rows)).where(F.col("value").isNotNull())
            .select("ord", "parameter", "value"))


def _any_contains(t: Column, markers: list[str]) -> Column:
    out = t.contains(markers[0])
    for mk in markers[1:]:
        out = out | t.contains(mk)
    return out


# ------------------------------------------------------------------ sorts --
def _dur_key() -> Column:
    return F.coalesce(F.when(F.col("duration_ms") >= 0, F.col("duration_ms")), F.lit(-1.0))


def _freed_key() -> Column:
    return F.coalesce(F.when(F.col("freed_bytes") >= 0, F.col("freed_bytes")), F.lit(-1))


def gc_sort_order(sort_by: str = "timestamp") -> list[Column]:
    """Full sort key (the original sorts are stable over service-major order)."""
    svc, ts = F.coalesce(F.col("service"), F.lit("")), F.col("timestamp_s")
    eid = F.coalesce(F.col("event_id"), F.lit(0))
    tail = [F.coalesce(F.col("path"), F.lit("")), F.coalesce(F.col("line_no"), F.lit(0))]
    if sort_by == "duration":          # descending via negated key
        return [-_dur_key(), svc, ts, eid, *tail]
    if sort_by == "freed":
        return [-_freed_key(), svc, ts, eid, *tail]
    if sort_by == "service_then_time":
        return [svc, ts, eid, *tail]
    return [ts, svc, eid, *tail]


def gc_sorted(events: DataFrame, sort_by: str = "timestamp",
              slices: int | None = None) -> DataFrame:
    """Events with ``pos``, their 1-based place in the chosen order.

    The position is computed per range slice plus the sizes of earlier
    slices, so no task holds the whole table."""
    x = O.slice_by_order(events, gc_sort_order(sort_by), slices)
    return O.drop_order_cols(O.index_in_order(x, "pos"))


def gc_top(events: DataFrame, by: str = "duration", n: int = 10) -> DataFrame:
    """Top ``n`` events by duration or freed bytes (all events, not only
    pauses), ties in timestamp order. TakeOrderedAndProject: each task keeps
    ``n`` rows."""
    key = _dur_key() if by == "duration" else _freed_key()
    return events.orderBy(-key, *gc_sort_order("timestamp")).limit(n)
