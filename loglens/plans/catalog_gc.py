"""GC queries of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gcparse as G
from ..operators import gc as GC
from ..session import stored
from ..sources import fixtures as FX
from . import oracle as O
from .catalog import joined, register

GE = "WITH " + O.GC_EVENTS


def events(spark, sf):
    return GC.gc_parse(FX.gc_lines(spark, sf))


@register("gc_parse", GE + f"\nSELECT {', '.join(chr(34) + c + chr(34) for c in GC.GC_COLUMNS)} FROM gev")
def gc_parse(spark, sf):
    return events(spark, sf)


@register("gc_classify", GE + """
SELECT line_no, kind, kind_short, stw, "full", cause FROM gev""")
def gc_classify(spark, sf):
    return events(spark, sf).select("line_no", "kind", "kind_short", "stw", "full", "cause")


@register("gc_parse_full_gc_only", GE.replace("FROM gl),\ngg AS", "FROM gl WHERE contains(line_text, 'Full GC')),\ngg AS") + """
SELECT line_no, kind FROM gev""")
def gc_parse_full_gc_only(spark, sf):
    # the path mode of the original greps the literal "Full GC" first
    return GC.gc_parse(FX.gc_lines(spark, sf), prefilter="Full GC").select("line_no", "kind")


@register("derive_service", "WITH " + O.LOG_LINES + f"""
SELECT line_no, {O.service('path')} AS service FROM ll""")
def derive_service(spark, sf):
    return FX.log_lines(spark, sf).select("line_no", G.service_from_path(F.col("path")).alias("service"))


@register("derive_executor", "WITH " + O.LOG_LINES + f"""
SELECT line_no, {O.executor('path')} AS executor_ip FROM ll""")
def derive_executor(spark, sf):
    return FX.log_lines(spark, sf).select(
        "line_no", G.executor_from_path(F.col("path")).alias("executor_ip"))


_ORDER = "coalesce(service, ''), timestamp_s, coalesce(event_id, 0), coalesce(path, ''), coalesce(line_no, 0)"


@register("gc_interval_global", GE + f"""
SELECT path, line_no, timestamp_s - lag(timestamp_s) OVER (ORDER BY {_ORDER}) AS interval_prev_s FROM gev""")
def gc_interval_global(spark, sf):
    return GC.gc_with_intervals(events(spark, sf)).select("path", "line_no", "interval_prev_s")


@register("gc_interval_service", GE + f"""
SELECT path, line_no, timestamp_s - lag(timestamp_s) OVER (PARTITION BY coalesce(service, '_') ORDER BY {_ORDER})
  AS interval_prev_service_s FROM gev""")
def gc_interval_service(spark, sf):
    return GC.gc_with_intervals(events(spark, sf)).select("path", "line_no",
                                                         "interval_prev_service_s")


@register("gc_filter", GE + """
SELECT path, line_no, duration_ms FROM gev WHERE duration_ms >= 500.0 AND stw""")
def gc_filter(spark, sf):
    return GC.gc_filter(events(spark, sf), min_duration_ms=500.0, only_stw=True).select(
        "path", "line_no", "duration_ms")


_D = "CASE WHEN stw AND duration_ms >= 0 THEN duration_ms END"
_FR = "CASE WHEN freed_bytes >= 0 THEN freed_bytes END"
_TS = "CASE WHEN timestamp_s >= 0 THEN timestamp_s END"
GC_STATS_SQL = GE + f""",
st AS (
SELECT CAST(count(*) AS BIGINT) total_events, CAST(count(*) FILTER (WHERE stw) AS BIGINT) stw_events,
  CAST(count(*) FILTER (WHERE kind = 'concurrent') AS BIGINT) concurrent_events,
  CAST(count(*) FILTER (WHERE kind = 'pause_young') AS BIGINT) young_gc,
  CAST(count(*) FILTER (WHERE "full") AS BIGINT) full_gc,
  CAST(count(*) FILTER (WHERE kind = 'remark') AS BIGINT) remark,
  CAST(count(*) FILTER (WHERE kind = 'cleanup') AS BIGINT) cleanup,
  coalesce(sum({_D}), 0.0) total_stw_pause_ms, avg({_D}) avg_pause_ms,
  quantile_cont({_D}, 0.5) p50_pause_ms, quantile_cont({_D}, 0.95) p95_pause_ms,
  quantile_cont({_D}, 0.99) p99_pause_ms,
  coalesce(sum({_FR}), 0) / 1048576.0 total_freed_mb, max({_FR}) / 1048576.0 max_freed_mb,
  max({_D}) max_pause_ms,
  CASE WHEN count({_TS}) >= 2 THEN max({_TS}) - min({_TS}) END observed_span_s
FROM gev),
st2 AS (SELECT *, CASE WHEN observed_span_s > 0 THEN total_events / observed_span_s * 60.0 END events_per_min
        FROM st)"""


@register("gc_stats", GC_STATS_SQL + "\nSELECT * FROM st2")
def gc_stats(spark, sf):
    return GC.gc_stats(events(spark, sf))


@register("gc_pause_percentiles", GC_STATS_SQL + "\nSELECT p50_pause_ms, p95_pause_ms, p99_pause_ms FROM st2")
def gc_pause_percentiles(spark, sf):
    return GC.gc_pause_percentiles(events(spark, sf))


@register("gc_rate", GC_STATS_SQL + "\nSELECT observed_span_s, events_per_min FROM st2")
def gc_rate(spark, sf):
    return GC.gc_stats(events(spark, sf), percentiles=False).select("observed_span_s", "events_per_min")


@register("gc_pause_sketch", GE + f"""
SELECT coalesce({O.executor('path')}, '') executor_ip, count(*) n, true p50_near, true p95_near, true p99_near
FROM gev WHERE stw AND duration_ms >= 0 GROUP BY ALL""")
def gc_pause_sketch(spark, sf):
    """Hourly sketches, kept and merged for each executor; are the true ranks of their quantiles within the stated error?"""
    ps = (0.5, 0.95, 0.99)
    ev = events(spark, sf)
    sketches = stored(GC.gc_pause_sketches(ev, k=800))
    got = stored(GC.sketch_quantiles(GC.merge_sketches(sketches, "executor_ip"), ps))
    pauses = ev.where("stw AND duration_ms >= 0").select(G.executor_from_path(F.col("path")).alias("executor_ip"), "duration_ms")
    err = GC.sketch_rank_error(200)
    def near(p):
        q = F.col(f"p{round(p * 100)}")
        below, upto = F.count_if(F.col("duration_ms") < q), F.count_if(F.col("duration_ms") <= q)
        return ((below <= (p + err) * F.count("*")) & (upto >= (p - err) * F.count("*"))).alias(f"p{round(p * 100)}_near")
    return pauses.join(got, "executor_ip").groupBy("executor_ip", "n").agg(*map(near, ps))


GC_BY_EXEC_SQL = GE + f""",
ag AS (
SELECT executor_ip, CAST(count(*) AS BIGINT) total_events,
  CAST(count(*) FILTER (WHERE "full") AS BIGINT) full_gc_count,
  CAST(count(*) FILTER (WHERE kind = 'pause_young') AS BIGINT) young_gc_count,
  coalesce(max(CASE WHEN duration_ms >= 0 THEN duration_ms END), 0.0) max_duration_ms,
  coalesce(avg(CASE WHEN duration_ms >= 0 THEN duration_ms END), 0.0) avg_duration_ms,
  coalesce(max(CASE WHEN heap_bytes > 0 AND mem_after_bytes >= 0 THEN mem_after_bytes / heap_bytes * 100.0 END), 0.0)
    max_heap_used_pct,
  CAST(coalesce(max(CASE WHEN mem_after_bytes >= 0 THEN mem_after_bytes END), 0) AS BIGINT) max_heap_used_bytes
FROM (SELECT *, {O.executor('path')} executor_ip FROM gev) GROUP BY executor_ip),
hl AS (
SELECT *, CASE WHEN max_duration_ms > 0 THEN max_duration_ms / 1000.0 ELSE 0.0 END max_duration_sec,
  CASE WHEN full_gc_count >= 15 THEN 'heavy' WHEN full_gc_count >= 5 THEN 'moderate' ELSE 'healthy' END base
FROM ag)
SELECT executor_ip, total_events, full_gc_count, young_gc_count, max_duration_ms, avg_duration_ms,
  max_heap_used_pct, max_heap_used_bytes, max_duration_sec,
  CASE WHEN base = 'healthy' AND (max_duration_ms >= 1000 OR max_heap_used_pct >= 90) THEN '⚠️ Heavy GC activity'
       WHEN base = 'heavy' THEN '⚠️ Heavy GC activity' WHEN base = 'moderate' THEN '⚠️ Moderate GC activity'
       ELSE '✅ Healthy' END health_status,
  nullif(concat_ws('|',
    CASE WHEN full_gc_count >= 15 THEN 'Excessive Full GCs' WHEN full_gc_count >= 5 THEN 'High Full GC count' END,
    CASE WHEN max_duration_ms >= 1000 THEN 'Long pause (' || {O.fmt('max_duration_ms / 1000.0', 2)} || 's)' END,
    CASE WHEN max_heap_used_pct >= 90 THEN 'High heap pressure (' || {O.fmt('max_heap_used_pct', 0)} || '%)' END), '')
    health_issues
FROM hl"""


@register("gc_by_executor", GC_BY_EXEC_SQL)
def gc_by_executor(spark, sf):
    x = GC.gc_by_executor(events(spark, sf))
    return x.withColumn("health_issues", joined("health_issues"))


@register("gc_health", GC_BY_EXEC_SQL.replace(
    "SELECT executor_ip, total_events, full_gc_count, young_gc_count, max_duration_ms, avg_duration_ms,\n"
    "  max_heap_used_pct, max_heap_used_bytes, max_duration_sec,", "SELECT executor_ip,"))
def gc_health(spark, sf):
    x = GC.gc_by_executor(events(spark, sf))
    return x.select("executor_ip", "health_status", joined("health_issues").alias("health_issues"))


@register("gc_executor_ranking", GC_BY_EXEC_SQL.replace(
    "SELECT executor_ip, total_events,", "SELECT row_number() OVER (ORDER BY full_gc_count DESC, executor_ip) AS rank, executor_ip, total_events,")
    .replace("FROM hl", "FROM hl WHERE executor_ip NOT IN ('driver', 'unknown')"))
def gc_executor_ranking(spark, sf):
    from pyspark.sql import Window
    r = GC.gc_executor_ranking(GC.gc_by_executor(events(spark, sf)))
    # one row per executor: the ranking window sees a small table
    w = Window.orderBy(F.desc("full_gc_count"), "executor_ip")
    return (r.withColumn("rank", F.row_number().over(w))
            .withColumn("health_issues", joined("health_issues")))


@register("gc_config", GE.split(",\ngm AS")[0] + f""",
xm AS (SELECT regexp_extract(line_text, '-Xmx([\\d\\.]+)([GMK])', 1) n, regexp_extract(line_text, '-Xmx([\\d\\.]+)([GMK])', 2) u
       FROM gl WHERE regexp_matches(line_text, '-Xmx([\\d\\.]+)([GMK])') ORDER BY path, line_no LIMIT 1),
hs AS (SELECT max({O.size_bytes('s')}) mx FROM (SELECT unnest(regexp_extract_all(line_text, '\\((\\d+(?:\\.\\d+)?[KMGT])\\)', 1)) s FROM gl)),
al AS (SELECT bool_or(contains(line_text, 'G1')) g1, bool_or(contains(line_text, 'ParallelGC') OR contains(line_text, 'PSYoungGen')) par,
              bool_or(contains(line_text, 'CMS')) cms FROM gl),
r AS (
  SELECT 1 ord, 'Max Heap Size' parameter, coalesce(
     (SELECT CASE WHEN u = 'G' THEN CAST(TRY_CAST(n AS DOUBLE) AS VARCHAR) || ' GB (-Xmx' || n || u || ')'
                  WHEN u = 'M' THEN {O.fmt('TRY_CAST(n AS DOUBLE) / 1024.0', 1)} || ' GB (-Xmx' || n || u || ')' END FROM xm),
     (SELECT CASE WHEN mx > 0 THEN {O.fmt('mx / 1073741824.0', 1)} || ' GB (~observed)' END FROM hs)) value
  UNION ALL
  SELECT 2, 'GC Algorithm', CASE WHEN g1 THEN 'G1 Garbage Collector' WHEN par THEN 'Parallel GC'
                                 WHEN cms THEN 'Concurrent Mark Sweep (CMS)' END FROM al)
SELECT ord, parameter, value FROM r WHERE value IS NOT NULL""")
def gc_config(spark, sf):
    return GC.gc_config(FX.gc_lines(spark, sf))


def _sorted_sql(key: str) -> str:
    return GE + f"""
SELECT path, line_no, CAST(row_number() OVER (ORDER BY {key}) AS BIGINT) AS pos FROM gev"""


_DUR_KEY = "-coalesce(CASE WHEN duration_ms >= 0 THEN duration_ms END, -1.0)"
_FREED_KEY = "-coalesce(CASE WHEN freed_bytes >= 0 THEN freed_bytes END, -1)"
_TAIL = "coalesce(path, ''), coalesce(line_no, 0)"


@register("gc_sorted", _sorted_sql(f"{_DUR_KEY}, coalesce(service, ''), timestamp_s, coalesce(event_id, 0), {_TAIL}"))
def gc_sorted(spark, sf):
    return GC.gc_sorted(events(spark, sf), "duration").select("path", "line_no", "pos")


@register("gc_sorted_time", _sorted_sql(f"timestamp_s, coalesce(service, ''), coalesce(event_id, 0), {_TAIL}"))
def gc_sorted_time(spark, sf):
    return GC.gc_sorted(events(spark, sf), "timestamp").select("path", "line_no", "pos")


@register("gc_sorted_freed", _sorted_sql(f"{_FREED_KEY}, coalesce(service, ''), timestamp_s, coalesce(event_id, 0), {_TAIL}"))
def gc_sorted_freed(spark, sf):
    return GC.gc_sorted(events(spark, sf), "freed").select("path", "line_no", "pos")


@register("gc_sorted_service", _sorted_sql(f"coalesce(service, ''), timestamp_s, coalesce(event_id, 0), {_TAIL}"))
def gc_sorted_service(spark, sf):
    return GC.gc_sorted(events(spark, sf), "service_then_time").select("path", "line_no", "pos")


_TS_ORDER = f"timestamp_s, coalesce(service, ''), coalesce(event_id, 0), {_TAIL}"


@register("gc_top_pauses", GE + f"""
SELECT path, line_no, duration_ms FROM gev ORDER BY {_DUR_KEY}, {_TS_ORDER} LIMIT 10""")
def gc_top_pauses(spark, sf):
    return GC.gc_top(events(spark, sf), "duration", 10).select("path", "line_no", "duration_ms")


@register("gc_top_freed", GE + f"""
SELECT path, line_no, freed_bytes FROM gev ORDER BY {_FREED_KEY}, {_TS_ORDER} LIMIT 10""")
def gc_top_freed(spark, sf):
    return GC.gc_top(events(spark, sf), "freed", 10).select("path", "line_no", "freed_bytes")


@register("gc_driver_events", GE + """
SELECT path, line_no FROM gev WHERE contains(lower(coalesce(path, 'None')), 'driver')""")
def gc_driver_events(spark, sf):
    return GC.gc_driver_events(events(spark, sf)).select("path", "line_no")


@register("gc_parse_compat", GE + """
SELECT path, line_no, coalesce(duration_ms, -1.0) duration_ms, coalesce(mem_before_bytes, -1) mem_before_bytes,
  coalesce(mem_after_bytes, -1) mem_after_bytes, coalesce(heap_bytes, -1) heap_bytes,
  coalesce(freed_bytes, -1) freed_bytes, coalesce(freed_pct, -1.0) freed_pct FROM gev""")
def gc_parse_compat(spark, sf):
    return GC.gc_compat(events(spark, sf)).select(
        "path", "line_no", "duration_ms", "mem_before_bytes", "mem_after_bytes", "heap_bytes",
        "freed_bytes", "freed_pct")


@register("gc_interval_time_major", GE + """
SELECT path, line_no, timestamp_s - lag(timestamp_s) OVER (ORDER BY timestamp_s, coalesce(service, ''),
  coalesce(event_id, 0), coalesce(path, ''), coalesce(line_no, 0)) AS interval_prev_s FROM gev""")
def gc_interval_time_major(spark, sf):
    return GC.gc_with_intervals(events(spark, sf), global_order="time").select(
        "path", "line_no", "interval_prev_s")
