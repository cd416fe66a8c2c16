"""Report tables: DataFrames with the display columns of the original
markdown tables (GC tables, executor summary, evidence summaries, case
record). Row limits are TakeOrderedAndProject (k rows per task); the
"more rows" counts are scalar subqueries, not joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gcparse as G
from ..functions import patterns as P
from ..functions import text as T
from . import gc as GC


def _ts3(ts: Column) -> Column:
    return F.when(ts.isNotNull() & (ts >= 0), F.concat(G.fmt_fixed(ts, 3), F.lit("s"))) \
        .otherwise(F.lit("?"))


def _limited(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows in ``order`` with ``pos`` 1..k and ``more_rows``."""
    total = df.agg(F.count(F.lit(1))).scalar()
    top = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    keys = [f"_o{i}" for i in range(len(order))]
    top = top.orderBy(*keys).limit(k)
    w = Window.orderBy(*keys)          # at most k rows
    return (top.withColumn("pos", F.row_number().over(w).cast("bigint"))
            .withColumn("more_rows", F.greatest(total - k, F.lit(0)).cast("bigint"))
            .drop(*keys))


def report_gc_main(events_iv: DataFrame, sort_by: str = "duration", max_rows: int = 100) -> DataFrame:
    """GC | Svc | Timestamp | Duration | Kind | Cause | Before->After | Heap |
    Freed | Freed % | dprev(s); events need the interval columns."""
    r = _limited(events_iv, GC.gc_sort_order(sort_by), max_rows)
    ivs = F.col("interval_prev_service_s")
    return r.select(
        "pos", F.col("event").alias("gc"), F.coalesce("service", F.lit("")).alias("svc"),
        _ts3(F.col("timestamp_s")).alias("timestamp"), G.nice_ms(F.col("duration_ms")).alias("duration"),
        F.col("kind_short").alias("kind"), F.coalesce("cause", F.lit("")).alias("cause"),
        F.concat(F.col("mem_before_str"), F.lit("→"), F.col("mem_after_str")).alias("before_after"),
        F.col("heap_str").alias("heap"), F.col("freed_mb_str").alias("freed"),
        G.pct(F.coalesce(F.col("freed_pct"), F.lit(-1.0))).alias("freed_pct"),
        F.when(ivs.isNotNull() & (ivs != -1), G.fmt_fixed(ivs, 3)).otherwise(F.lit("")).alias("dprev"),
        "more_rows")


def report_gc_top(events: DataFrame, by: str = "duration", n: int = 10) -> DataFrame:
    """GC | Svc | Timestamp | Duration | Before->After | Freed of the top n."""
    top = GC.gc_top(events, by, n)
    key = GC._dur_key() if by == "duration" else GC._freed_key()
    w = Window.orderBy(-key, *GC.gc_sort_order("timestamp"))     # n rows
    return top.select(
        F.row_number().over(w).cast("bigint").alias("pos"), F.col("event").alias("gc"),
        F.coalesce("service", F.lit("")).alias("svc"), _ts3(F.col("timestamp_s")).alias("timestamp"),
        G.nice_ms(F.col("duration_ms")).alias("duration"),
        F.concat(F.col("mem_before_str"), F.lit("→"), F.col("mem_after_str")).alias("before_after"),
        F.col("freed_mb_str").alias("freed"))


# (label, stats field, unit) in display order; None marks a paragraph break
SUMMARY_LAYOUT = [
    [("Events", "total_events", ""), ("STW", "stw_events", ""),
     ("Concurrent", "concurrent_events", ""), ("Young", "young_gc", ""),
     ("Full", "full_gc", ""), ("Remark", "remark", ""), ("Cleanup", "cleanup", "")],
    [("Total STW pause", "total_stw_pause_ms", "ms"),
     ("p50/p95/p99", ("p50_pause_ms", "p95_pause_ms", "p99_pause_ms"), "ms")],
    [("Total freed", "total_freed_mb", "mb"), ("Max freed", "max_freed_mb", "mb"),
     ("Max pause", "max_pause_ms", "ms")],
    [("Observed window", "observed_span_s", "s"), ("Event rate", "events_per_min", "rate")],
]


def _val(c: Column, unit: str) -> Column:
    missing = c.isNull() | (c == -1)
    if unit == "ms":
        shown = G.nice_ms(c)
    elif unit == "mb":
        shown = F.concat(G.fmt_fixed(c, 0, True), F.lit("MB"))
    elif unit == "s":
        shown = F.concat(G.fmt_fixed(c, 3, True), F.lit("s"))
    elif unit == "rate":
        shown = F.when(c >= 0, F.concat(G.fmt_fixed(c, 2), F.lit("/min"))).otherwise(F.lit("?"))
    else:
        shown = F.format_number(c, 0)
    return F.when(missing, F.lit("?")).otherwise(shown)


def report_gc_summary(stats: DataFrame) -> DataFrame:
    """The summary paragraph of the GC analysis (one row, one string)."""
    paras = []
    for para in SUMMARY_LAYOUT:
        items = []
        for label, field, unit in para:
            if isinstance(field, tuple):
                v = F.concat_ws(" / ", *[_val(F.col(f), unit) for f in field])
            else:
                v = _val(F.col(field), unit)
            items.append(F.concat(F.lit(f"**{label}:** "), v))
        paras.append(F.concat_ws("  •  ", *items))
    return stats.select(F.concat_ws("\n\n", *paras).alias("summary"))


def report_gc_driver(events: DataFrame, sort_by: str = "duration", max_rows: int = 50) -> DataFrame:
    """Driver GC events: Timestamp | GC Type | Duration | Before | After |
    Reclaimed | Heap % Used."""
    r = _limited(GC.gc_driver_events(events), GC.gc_sort_order(sort_by), max_rows)
    ts, dur = F.col("timestamp_s"), F.col("duration_ms")
    heap_ok = (F.col("heap_bytes") > 0) & (F.col("mem_after_bytes") >= 0)
    return r.select(
        "pos",
        F.when(ts >= 0, F.concat(G.fmt_fixed(ts, 0), F.lit("s"))).otherwise(F.lit("?")).alias("timestamp"),
        F.when(F.col("full"), F.lit("Full GC")).otherwise(F.coalesce("kind_short", F.lit("GC"))).alias("gc_type"),
        F.when(dur >= 0, G.fmt_fixed(dur / 1000.0, 2)).otherwise(F.lit("?")).alias("duration"),
        F.col("mem_before_str").alias("before"), F.col("mem_after_str").alias("after"),
        F.col("freed_mb_str").alias("reclaimed"),
        F.when(heap_ok, F.concat(G.fmt_fixed(F.col("mem_after_bytes") / F.col("heap_bytes") * 100.0, 0),
                                 F.lit("%"))).otherwise(F.lit("?")).alias("heap_pct"),
        "more_rows")


def report_gc_executors(by_exec: DataFrame) -> DataFrame:
    """Executor IP | Total Full GCs (``N+`` from 15) | Max GC Duration |
    Max Heap Used | GC Status, executors by full GCs."""
    r = GC.gc_executor_ranking(by_exec)
    w = Window.orderBy(F.desc("full_gc_count"), "executor_ip")   # one row per executor
    full, sec = F.col("full_gc_count"), F.col("max_duration_sec")
    return r.select(
        F.row_number().over(w).cast("bigint").alias("pos"), "executor_ip",
        F.when(full >= 15, F.concat(full.cast("string"), F.lit("+"))).otherwise(full.cast("string"))
        .alias("full_gcs"),
        F.when(sec > 0, F.concat(G.fmt_fixed(sec, 2), F.lit(" sec"))).otherwise(F.lit("?"))
        .alias("max_duration"),
        G.bytes_to_mb(F.col("max_heap_used_bytes")).alias("max_heap"),
        F.col("health_status").alias("status"))


def report_evidence_class(ev: DataFrame) -> DataFrame:
    """pattern, count, files, time range, 5 variables, sample (<= 150)."""
    ts = F.col("timestamps")
    rng = (F.when(F.size(ts) > 1, F.concat(F.element_at(ts, 1), F.lit(" ... "), F.element_at(ts, -1)))
           .when(F.size(ts) == 1, F.element_at(ts, 1)))
    w = Window.orderBy(F.desc("count"), "pattern")               # nine classes at most
    return ev.select(
        F.row_number().over(w).cast("bigint").alias("pos"), "pattern", "count",
        F.size("files").cast("bigint").alias("files"), rng.alias("time_range"),
        F.when(F.size("variables") > 0, F.array_join(F.slice("variables", 1, 5), ", ")).alias("variables"),
        F.when(F.size("sample_lines") > 0, T.truncate(F.element_at("sample_lines", 1), 150)).alias("sample"))


def report_evidence_template(ev: DataFrame, max_patterns: int = 50) -> DataFrame:
    """rank, pattern, occurrences, timestamps (5 shown), files (3 shown),
    sample (200 chars + '...'), top ``max_patterns`` by count."""
    def shown(arr: str, n_col: str, k: int) -> Column:
        a = F.col(arr)
        more = F.concat(F.lit(" ... (+"), (F.col(n_col) - k).cast("string"), F.lit(" more)"))
        head = F.array_join(F.slice(a, 1, k), ", ")
        return F.when(F.size(a) == 0, F.lit(None)).when(F.col(n_col) > k, F.concat(head, more)) \
            .otherwise(head)
    r = _limited(ev, [-F.col("count"), F.col("pattern")], max_patterns)
    return r.select(
        F.col("pos").alias("rank"), "pattern", F.col("count").alias("occurrences"),
        shown("timestamps", "n_timestamps", 5).alias("timestamps"),
        shown("files", "n_files", 3).alias("files"),
        F.when(F.size("sample_lines") > 0, T.truncate(F.element_at("sample_lines", 1), 200, True))
        .alias("sample"),
        F.col("more_rows").alias("more_patterns"))


def report_case(cases: DataFrame, critic: DataFrame, action: DataFrame,
                keywords: DataFrame, evidence: DataFrame, errors: DataFrame) -> DataFrame:
    """The final case record: problem, confidence, iterations, evidence size,
    keywords, critic verdict."""
    ev = evidence.groupBy("case_id").agg(F.count(F.lit(1)).cast("bigint").alias("evidence_patterns"),
                                         F.sum("count").cast("bigint").alias("evidence_occurrences"))
    x = (cases.select("case_id").join(critic, "case_id").join(action, "case_id")
         .join(keywords.select("case_id", "keywords"), "case_id")
         .join(ev, "case_id", "left").join(errors.select("case_id", "has_input_error", "problem"),
                                           "case_id"))
    return x.select(
        "case_id",
        F.coalesce("problem", F.lit("Root cause analysis")).alias("problem"),
        F.when(F.col("has_input_error"), F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"),
        "critic_approved", "critique", F.col("new_iteration").alias("iterations"),
        "next_action", F.array_join("keywords", ", ").alias("keywords"),
        F.coalesce("evidence_patterns", F.lit(0)).cast("bigint").alias("evidence_patterns"),
        F.coalesce("evidence_occurrences", F.lit(0)).cast("bigint").alias("evidence_occurrences"))


def case_record(cases: DataFrame, critic: DataFrame, action: DataFrame, keywords: DataFrame, hypotheses: DataFrame,
                drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """The whole record of a case: its draft (problem, rca, mitigation), confidence, iterations, critic's verdict,
    next action, keywords, hypotheses and evidence rows.

    A diagnostic draft (``cases.diagnostic_draft``) takes the place of the case's own; empty texts say that they are unspecified. ``evidence_map``
    holds (pattern, count) by count: a case's evidence by class, so nine rows at most.
    """
    ev = (evidence.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "pattern"))).alias("e"))
          .select("case_id", F.transform("e", lambda x: F.struct(x["pattern"].alias("pattern"), (-x["n"]).alias("count"))).alias("evidence_map")))
    own = cases.select("case_id", *[F.col(c).alias(f"own_{c}") for c in ("problem", "rca", "mitigation")])
    diag = drafts.select("case_id", F.lit(True).alias("diag"), *[F.col(c).alias(f"diag_{c}") for c in ("problem", "rca", "mitigation", "confidence")])
    x = own
    for part in (critic, action, keywords.select("case_id", "keywords"), hypotheses):
        x = x.join(part, "case_id")
    x = x.join(diag, "case_id", "left").join(ev, "case_id", "left")

    def text(name, missing):
        mine = F.trim(F.coalesce(f"own_{name}", F.lit("")))
        return F.when(F.col("diag"), F.col(f"diag_{name}")).when(mine != "", mine).otherwise(F.lit(missing)).alias(name)
    none = F.array().cast("array<struct<pattern:string,count:bigint>>")
    return x.select("case_id", text("problem", P.PROBLEM_UNSPECIFIED), text("rca", P.RCA_UNSPECIFIED), text("mitigation", P.MITIGATION_UNSPECIFIED),
                    F.coalesce("diag_confidence", "confidence").alias("confidence"), F.col("new_iteration").alias("iterations"),
                    "critic_approved", "critique", "next_action", "keywords", "hypotheses", F.coalesce("evidence_map", none).alias("evidence_map"))


def search_payload(ev: DataFrame) -> DataFrame:
    """The search tool's combined record, one row: total_matches, patterns_found, evidence_map, evidence_summary.

    ``ev`` is the class-keyed map, nine rows at most; patterns by count (ties by name). The summary is the tool's text:
    a heading, and for each pattern its count and files, time range, five variables and first sample.
    """
    r = report_evidence_class(ev).select("pos", "pattern", "files", "time_range", "variables", "sample")
    part = F.concat(F.lit("\n\n**"), "pattern", F.lit("**: "), F.col("count").cast("string"), F.lit(" occurrences across "),
                    F.col("n").cast("string"), F.lit(" files"),
                    F.coalesce(F.concat(F.lit("\n  - Time range: "), "time_range"), F.lit("")),
                    F.coalesce(F.concat(F.lit("\n  - Variables: "), "shown"), F.lit("")),
                    F.coalesce(F.concat(F.lit("\n  - Sample: `"), "sample", F.lit("`")), F.lit("")))
    entry = F.struct("pattern", "count", "timestamps", "files", "sample_lines", "variables").alias("entry")
    x = (ev.select("pattern", "count", entry).join(r.select("pos", "pattern", F.col("files").alias("n"), "time_range",
                                                                F.col("variables").alias("shown"), "sample"), "pattern")
         .select("count", F.struct("pos", "entry", part.alias("text")).alias("s")))
    a = x.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total_matches"), F.array_sort(F.collect_list("s")).alias("all"))
    text = F.when(F.size("all") > 0, F.concat(F.lit("**Evidence Summary:**\n"), F.array_join(F.transform("all", lambda s: s["text"]), "")))
    return a.select("total_matches", F.transform("all", lambda s: s["entry"]["pattern"]).alias("patterns_found"),
                    F.transform("all", lambda s: s["entry"]).alias("evidence_map"),
                    F.coalesce(text, F.lit("No evidence collected")).alias("evidence_summary"))


# FIXED VALUES: markdown headers of the GC tables, and their empty-table notes
DRIVER_TABLE_HEADER = ("**Driver GC Events**\n\n"
                       "| Timestamp | GC Type | Duration | Before GC | After GC | Reclaimed | Heap % Used |\n"
                       "|---:|---|---:|---:|---:|---:|---:|")
DRIVER_TABLE_EMPTY = "_No driver GC events found_"
EXECUTOR_TABLE_HEADER = ("**Executor GC Summary**\n\n"
                         "| Executor IP | Total Full GCs | Max GC Duration | Max Heap Used | GC Status |\n"
                         "|---|---:|---:|---:|---|")
EXECUTOR_TABLE_EMPTY = "_No executor GC events found_"


def report_markdown(rows: DataFrame, cols: list[str], header: str, empty: str,
                    more: Column | None = None) -> DataFrame:
    """One-row markdown table of a *bounded* report (rows carry ``pos``):
    ``| a | b |`` lines in ``pos`` order under ``header``; ``empty`` when
    there is no row. Only for tables limited by construction (top-k, one row
    per executor)."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c) for c in cols]), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))),
                                    lambda s: s["l"]), "\n")
    aggs = [F.count(F.lit(1)).alias("_n"), body.alias("_b")]
    if more is not None:
        aggs.append(F.max(more).alias("_m"))
    a = rows.agg(*aggs)
    text = F.concat(F.lit(header + "\n"), F.col("_b"))
    if more is not None:
        text = F.concat(text, F.when(F.col("_m") > 0, F.concat(
            F.lit("\n\n_... "), F.col("_m").cast("string"), F.lit(" more events_"))).otherwise(F.lit("")))
    return a.select(F.when(F.col("_n") > 0, text).otherwise(F.lit(empty)).alias("markdown"))


def gc_evidence_row(events: DataFrame, sort_by: str = "duration", logs_path: str = "") -> DataFrame:
    """The GC analysis folded into one evidence row (pattern ``GC_Analysis``):
    summary, driver table and executor table, the text cut to 500 chars."""
    summary = report_gc_summary(GC.gc_stats(events)).select(F.col("summary").alias("_s"))
    drv = report_markdown(report_gc_driver(events, sort_by, 50),
                          ["timestamp", "gc_type", "duration", "before", "after", "reclaimed",
                           "heap_pct"], DRIVER_TABLE_HEADER, DRIVER_TABLE_EMPTY,
                          more=F.col("more_rows")).select(F.col("markdown").alias("_d"))
    exe = report_markdown(report_gc_executors(GC.gc_by_executor(events)),
                          ["executor_ip", "full_gcs", "max_duration", "max_heap", "status"],
                          EXECUTOR_TABLE_HEADER, EXECUTOR_TABLE_EMPTY).select(F.col("markdown").alias("_e"))
    text = F.concat_ws("\n\n", summary.select("_s").scalar(), drv.select("_d").scalar(),
                       exe.select("_e").scalar())
    spark = events.sparkSession
    return spark.range(1).select(
        F.lit("GC_Analysis").alias("pattern"), F.lit(1).cast("bigint").alias("count"),
        F.lit(logs_path).alias("files"), F.substring(text, 1, 500).alias("sample_lines"))
