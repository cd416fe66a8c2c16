"""Report-table and markdown queries of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import patterns as P
from ..operators import cases as C
from ..operators import evidence as E
from ..operators import gc as GC
from ..operators import report as R
from ..sources import fixtures as FX
from . import oracle as O
from .catalog import _EV_CLASS_SQL, _ev_template_sql, register
from .catalog_gc import GC_BY_EXEC_SQL, GC_STATS_SQL, GE, _DUR_KEY, _ORDER, _TAIL, _TS_ORDER, events
from .oracle import q

_MAIN_ORDER = f"{_DUR_KEY}, coalesce(service, ''), timestamp_s, coalesce(event_id, 0), {_TAIL}"


def _ts3(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {x} >= 0 THEN {O.fmt(x, 3)} || 's' ELSE '?' END"


@register("report_gc_main", GE + f""",
iv AS (SELECT *, timestamp_s - lag(timestamp_s) OVER (PARTITION BY coalesce(service, '_') ORDER BY {_ORDER}) ivs FROM gev),
r AS (SELECT *, row_number() OVER (ORDER BY {_MAIN_ORDER}) pos, count(*) OVER () total FROM iv)
SELECT CAST(pos AS BIGINT) pos, event gc, coalesce(service, '') svc, {_ts3('timestamp_s')} "timestamp",
  {O.nice_ms('duration_ms')} duration, kind_short kind, coalesce(cause, '') cause,
  mem_before_str || '→' || mem_after_str before_after, heap_str heap, freed_mb_str freed,
  {O.pct('coalesce(freed_pct, -1.0)')} freed_pct,
  CASE WHEN ivs IS NOT NULL AND ivs <> -1 THEN {O.fmt('ivs', 3)} ELSE '' END dprev,
  CAST(greatest(total - 100, 0) AS BIGINT) more_rows
FROM r WHERE pos <= 100""")
def report_gc_main(spark, sf):
    return R.report_gc_main(GC.gc_with_intervals(events(spark, sf)), "duration", 100)


def _top_sql(key: str) -> str:
    return GE + f""",
t AS (SELECT * FROM gev ORDER BY {key}, {_TS_ORDER} LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY {key}, {_TS_ORDER}) AS BIGINT) pos, event gc, coalesce(service, '') svc,
  {_ts3('timestamp_s')} "timestamp", {O.nice_ms('duration_ms')} duration,
  mem_before_str || '→' || mem_after_str before_after, freed_mb_str freed FROM t"""


@register("report_gc_top", _top_sql(_DUR_KEY))
def report_gc_top(spark, sf):
    return R.report_gc_top(events(spark, sf), "duration", 10)


@register("report_gc_top_freed", _top_sql("-coalesce(CASE WHEN freed_bytes >= 0 THEN freed_bytes END, -1)"))
def report_gc_top_freed(spark, sf):
    return R.report_gc_top(events(spark, sf), "freed", 10)


def _val_sql(c: str, unit: str) -> str:
    if unit == "ms":
        shown = O.nice_ms(c)
    elif unit == "mb":
        shown = f"{O.fmt(c, 0, True)} || 'MB'"
    elif unit == "s":
        shown = f"{O.fmt(c, 3, True)} || 's'"
    elif unit == "rate":
        shown = f"CASE WHEN {c} >= 0 THEN {O.fmt(c, 2)} || '/min' ELSE '?' END"
    else:
        shown = f"format('{{:,}}', {c})"
    return f"CASE WHEN {c} IS NULL OR {c} = -1 THEN '?' ELSE {shown} END"


def _summary_sql() -> str:
    paras = []
    for para in R.SUMMARY_LAYOUT:
        items = []
        for label, field, unit in para:
            if isinstance(field, tuple):
                v = "concat_ws(' / ', " + ", ".join(_val_sql(f, unit) for f in field) + ")"
            else:
                v = _val_sql(field, unit)
            items.append(f"{q('**' + label + ':** ')} || {v}")
        paras.append("concat_ws('  •  ', " + ", ".join(items) + ")")
    return GC_STATS_SQL + "\nSELECT concat_ws(chr(10) || chr(10), " + ", ".join(paras) + ") summary FROM st2"


@register("report_gc_summary", _summary_sql())
def report_gc_summary(spark, sf):
    return R.report_gc_summary(GC.gc_stats(events(spark, sf)))


ORACLE_DRIVER = GE + f""",
d AS (SELECT *, row_number() OVER (ORDER BY {_MAIN_ORDER}) pos, count(*) OVER () total FROM gev
      WHERE contains(lower(coalesce(path, 'None')), 'driver'))
SELECT CAST(pos AS BIGINT) pos, CASE WHEN timestamp_s >= 0 THEN {O.fmt('timestamp_s', 0)} || 's' ELSE '?' END "timestamp",
  CASE WHEN "full" THEN 'Full GC' ELSE coalesce(kind_short, 'GC') END gc_type,
  CASE WHEN duration_ms >= 0 THEN {O.fmt('duration_ms / 1000.0', 2)} ELSE '?' END duration,
  mem_before_str before, mem_after_str "after", freed_mb_str reclaimed,
  CASE WHEN heap_bytes > 0 AND mem_after_bytes >= 0 THEN {O.fmt('mem_after_bytes / heap_bytes * 100.0', 0)} || '%' ELSE '?' END heap_pct,
  CAST(greatest(total - 50, 0) AS BIGINT) more_rows
FROM d WHERE pos <= 50"""


@register("report_gc_driver", ORACLE_DRIVER)
def report_gc_driver(spark, sf):
    return R.report_gc_driver(events(spark, sf), "duration", 50)


ORACLE_EXECUTORS = f"""
SELECT CAST(row_number() OVER (ORDER BY full_gc_count DESC, executor_ip) AS BIGINT) pos, executor_ip,
  CASE WHEN full_gc_count >= 15 THEN CAST(full_gc_count AS VARCHAR) || '+' ELSE CAST(full_gc_count AS VARCHAR) END full_gcs,
  CASE WHEN max_duration_sec > 0 THEN {O.fmt('max_duration_sec', 2)} || ' sec' ELSE '?' END max_duration,
  {O.bytes_to_mb('max_heap_used_bytes')} max_heap, health_status status
FROM ({GC_BY_EXEC_SQL}) bx WHERE executor_ip NOT IN ('driver', 'unknown')"""


@register("report_gc_executors", ORACLE_EXECUTORS)
def report_gc_executors(spark, sf):
    return R.report_gc_executors(GC.gc_by_executor(events(spark, sf)))


def _trunc(x: str, n: int, always: bool = False) -> str:
    if always:
        return f"substr({x}, 1, {n}) || '...'"
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"


@register("report_evidence_class", _EV_CLASS_SQL + f""",
e2 AS (SELECT *, string_split(timestamps, '|') tl, string_split(sample_lines, '|')[1] s1 FROM ev)
SELECT CAST(row_number() OVER (ORDER BY count DESC, pattern) AS BIGINT) pos, pattern, count,
  CAST(coalesce(len(string_split(files, '|')), 0) AS BIGINT) files,
  CASE WHEN len(tl) > 1 THEN tl[1] || ' ... ' || tl[len(tl)] WHEN len(tl) = 1 THEN tl[1] END time_range,
  array_to_string(string_split(variables, '|')[1:5], ', ') variables, {_trunc('s1', 150)} sample
FROM e2""")
def report_evidence_class(spark, sf):
    return R.report_evidence_class(E.evidence_by_class(FX.log_lines(spark, sf)))


def _shown(col: str, n: str, k: int) -> str:
    return (f"CASE WHEN {col} IS NULL THEN NULL WHEN {n} > {k} THEN array_to_string(string_split({col}, '|')[1:{k}], ', ')"
            f" || ' ... (+' || CAST({n} - {k} AS VARCHAR) || ' more)' ELSE array_to_string(string_split({col}, '|')[1:{k}], ', ') END")


@register("report_evidence_template", _ev_template_sql(False) + f""",
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, pattern) rk, count(*) OVER () total FROM ev)
SELECT CAST(rk AS BIGINT) "rank", pattern, count occurrences, {_shown('timestamps', 'n_timestamps', 5)} timestamps,
  {_shown('files', 'n_files', 3)} files, {_trunc("string_split(sample_lines, '|')[1]", 200, True)} sample,
  CAST(greatest(total - 50, 0) AS BIGINT) more_patterns
FROM r WHERE rk <= 50""")
def report_evidence_template(spark, sf):
    ev = E.evidence_by_template(FX.log_lines(spark, sf), strip_prefix=False)
    return R.report_evidence_template(ev, 50)


def _inline_sql(x: str) -> str:
    for a, b in M.XML_ESCAPES:
        x = f"replace({x}, {q(a)}, {q(b)})"
    for rx, tmpl in M.INLINE_RULES:
        x = f"regexp_replace({x}, {q(rx)}, {q(tmpl.format(chr(92) + '1'))}, 'g')"
    return x


@register("markdown_inline", "WITH " + O.DOC_LINES + f"""
SELECT path, line_no, {_inline_sql('line_text')} html FROM dl""")
def markdown_inline(spark, sf):
    return FX.doc_lines(spark, sf).select("path", "line_no", M.inline(F.col("line_text")).alias("html"))


_S = O.strip("line_text")


_BLOCKS_SQL = f"""
m AS (SELECT *, starts_with({_S}, '```') fence FROM dl),
m2 AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 in_code FROM m),
m3 AS (SELECT *, CASE WHEN fence THEN 'fence' WHEN in_code THEN 'code' WHEN starts_with(line_text, '# ') THEN 'h1'
    WHEN starts_with(line_text, '## ') THEN 'h2' WHEN starts_with(line_text, '### ') THEN 'h3'
    WHEN starts_with({_S}, '- ') OR starts_with({_S}, '* ') THEN 'list_item' WHEN {_S} <> '' THEN 'paragraph'
    ELSE 'blank' END block_type FROM m2)
SELECT path, line_no, block_type,
  CASE block_type WHEN 'h1' THEN substr(line_text, 3) WHEN 'h2' THEN substr(line_text, 4) WHEN 'h3' THEN substr(line_text, 5)
    WHEN 'list_item' THEN {_inline_sql(f'substr({_S}, 3)')} WHEN 'paragraph' THEN {_inline_sql('line_text')}
    WHEN 'code' THEN line_text END text,
  CASE WHEN block_type = 'list_item' THEN sum((block_type IN ('paragraph', 'blank'))::INT) OVER (PARTITION BY path ORDER BY line_no) END list_id
FROM m3"""


@register("markdown_blocks", "WITH " + O.DOC_LINES + "," + _BLOCKS_SQL)
def markdown_blocks(spark, sf):
    b = M.blocks(FX.doc_lines(spark, sf), doc_col="path")
    return b.select("path", "line_no", "block_type", "text", F.col("list_id").cast("bigint").alias("list_id"))


@register("markdown_blocks_marked", "WITH " + O.LOG_LINES + """,
dl AS (SELECT path, line_no, CASE line_no % 12 WHEN 0 THEN '# ' || line_text WHEN 1 THEN '## ' || line_text WHEN 2 THEN '### ' || line_text
  WHEN 3 THEN ' - ' || line_text WHEN 4 THEN '* `' || line_text || '` **' || line_no || '**' WHEN 5 THEN '  '
  WHEN 6 THEN CASE WHEN line_no % 36 = 6 THEN ' ```' ELSE line_text END ELSE '- ' || line_text END line_text FROM ll),""" + _BLOCKS_SQL)
def markdown_blocks_marked(spark, sf):
    # a document for each log file: it lies across many slices, with its code and lists
    b = M.blocks(FX.marked_lines(spark, sf), doc_col="path", slices=16)
    return b.select("path", "line_no", "block_type", "text", F.col("list_id").cast("bigint").alias("list_id"))


ORACLE_REPORT_CASE = "WITH " + O.CASES + f""",
cg AS (SELECT case_id, critic_approve, {O.strip("coalesce(critic_reasons, '')")} reasons,
        greatest(0.0, least(1.0, coalesce(confidence, 0.5) + greatest(-0.25, least(0.25, coalesce(critic_adjust, 0.0))))) conf
      FROM cases),
cg2 AS (SELECT case_id, critic_approve AND conf >= 0.6 ok2,
  CASE WHEN conf < 0.6 AND reasons = '' THEN {q(P.CRITIC_LOW_DEFAULT)}
       WHEN conf < 0.6 THEN 'Confidence too low (' || {O.fmt('conf', 2)} || '). ' || reasons ELSE reasons END critique, conf FROM cg),
na AS (SELECT case_id, iteration it, coalesce(last_status, '') st, coalesce(critic_approved, false) ok, confidence c0,
        lower({O.strip("coalesce(proposed_action, '')")}) prop,
        CASE WHEN iteration = 0 THEN ['reasoning']
             WHEN coalesce(last_status, '') = 'summarized' AND NOT coalesce(critic_approved, false) THEN ['critic', 'reasoning']
             WHEN coalesce(critic_approved, false) THEN ['end', 'reasoning'] ELSE ['reasoning'] END allowed FROM cases),
na2 AS (SELECT case_id, it, CASE WHEN it >= 6 AND st <> '' THEN 'end' WHEN list_contains(allowed, prop) THEN prop
        WHEN it = 0 THEN 'reasoning' WHEN st = 'summarized' AND NOT ok THEN 'critic'
        WHEN ok AND c0 >= 0.75 THEN 'end' ELSE 'reasoning' END nxt FROM na),
kw AS (SELECT case_id, existing, {O.dedupe_keep_order("list_concat([" + ", ".join(q(k) for k in P.DEFAULT_KEYWORDS) + "], suggested)")}[1:15] gen FROM cases),
kw2 AS (SELECT case_id, {O.dedupe_keep_order('list_concat(existing, gen)')} keywords FROM kw),
evs AS (SELECT case_id, CAST(count(*) AS BIGINT) np, CAST(sum(count) AS BIGINT) no FROM cev GROUP BY case_id),
er AS (SELECT case_id, bool_or(contains(pattern, 'CRITICAL_ERROR') OR contains(pattern, 'error_no')) bad FROM
        (SELECT case_id, pattern FROM cev UNION ALL SELECT case_id, 'CRITICAL_ERROR_NO_LOGS_PATH' FROM cases WHERE trim(logs_path) = '')
       GROUP BY case_id)
SELECT cases.case_id,
  CASE WHEN coalesce(er.bad, false) THEN 'System Configuration Error: Unable to perform analysis due to missing or invalid inputs.'
       ELSE 'Root cause analysis' END problem,
  CASE WHEN coalesce(er.bad, false) THEN 0.0 ELSE cg2.conf END confidence,
  cg2.ok2 critic_approved, cg2.critique, CASE WHEN nxt = 'reasoning' THEN it + 1 ELSE it END iterations,
  nxt next_action, array_to_string(kw2.keywords, ', ') keywords,
  coalesce(evs.np, 0) evidence_patterns, coalesce(evs.no, 0) evidence_occurrences
FROM cases JOIN cg2 USING (case_id) JOIN na2 USING (case_id) JOIN kw2 USING (case_id)
  LEFT JOIN evs USING (case_id) LEFT JOIN er USING (case_id)"""


@register("report_case", ORACLE_REPORT_CASE)
def report_case(spark, sf):
    cs = FX.cases(spark, sf).withColumn("keywords", F.col("existing"))
    ev = FX.case_evidence(spark, sf)
    return R.report_case(cs, C.critic_gate(cs), C.next_action(cs), C.keyword_union(cs), ev,
                         C.input_errors(cs, ev))


def _md_sql(sql: str, cols: list[str], header: str, empty: str, more: bool) -> str:
    line = "'| ' || concat_ws(' | ', " + ", ".join(f'"{c}"' for c in cols) + ") || ' |'"
    tail = (" || CASE WHEN max(more_rows) > 0 THEN chr(10) || chr(10) || '_... ' || CAST(max(more_rows) AS VARCHAR)"
            " || ' more events_' ELSE '' END") if more else ""
    return (f"SELECT CASE WHEN count(*) > 0 THEN {q(header)} || chr(10) || "
            f"string_agg({line}, chr(10) ORDER BY pos){tail} ELSE {q(empty)} END md FROM ({sql}) t")


@register("gc_evidence_row", f"""
WITH sm AS ({_summary_sql()}),
drv AS ({_md_sql(ORACLE_DRIVER, ["timestamp", "gc_type", "duration", "before", "after", "reclaimed", "heap_pct"],
                 R.DRIVER_TABLE_HEADER, R.DRIVER_TABLE_EMPTY, True)}),
exe AS ({_md_sql(ORACLE_EXECUTORS, ["executor_ip", "full_gcs", "max_duration", "max_heap", "status"],
                 R.EXECUTOR_TABLE_HEADER, R.EXECUTOR_TABLE_EMPTY, False)})
SELECT 'GC_Analysis' pattern, CAST(1 AS BIGINT) count, '' files,
  substr(concat_ws(chr(10) || chr(10), (SELECT summary FROM sm), (SELECT md FROM drv), (SELECT md FROM exe)), 1, 500) sample_lines""")
def gc_evidence_row(spark, sf):
    return R.gc_evidence_row(events(spark, sf), "duration")
