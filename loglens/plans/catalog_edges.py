"""Queries over inputs that reach every branch of the rules (``fixtures.edge_cases``, ``gc_edge_lines``).

The SQL spells its rules and texts out on its own; it takes none from the Spark side's tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gcparse as G
from ..operators import cases as C
from ..operators import evidence as E
from ..operators import gc as GC
from ..operators import report as R
from ..sources import fixtures as FX
from . import oracle as O
from .catalog import _EV_CLASS_SQL, _EV_COLS, joined, register
from .catalog_gc import GC_BY_EXEC_SQL, GE

EDGE = "WITH " + O.CASES + """,
ec AS (SELECT case_id, CASE WHEN case_id % 5 = 3 THEN []::VARCHAR[] ELSE cases.suggested END suggested, iteration, last_status, confidence, critic_approved, proposed_action, critic_adjust, critic_approve, critic_reasons,
    analyze_parse_loops,
    CASE WHEN case_id % 7 = 0 THEN '  ' ELSE '/Volumes/logs/case-' || case_id END logs_path,
    CASE WHEN case_id % 3 = 0 THEN []::VARCHAR[] ELSE existing END keywords,
    CASE case_id % 5 WHEN 0 THEN list_concat(existing, ['GC overhead']) WHEN 1 THEN list_concat(existing, ['Out of MEMORY'])
      WHEN 2 THEN list_concat(list_concat(existing, ['ERROR', 'exception', 'Executor lost', 'OutOfMemoryError', 'GC overhead', 'Container exited']), cases.suggested)
      ELSE existing END existing,
    CASE case_id % 6 WHEN 0 THEN '' WHEN 1 THEN '[PROVEN] a. [INFERRED] b. [INFERRED] c.' WHEN 2 THEN '[INFERRED] x.'
      WHEN 3 THEN repeat('[PROVEN] p. ', CAST(case_id % 8 AS INTEGER)) ELSE rca END rca,
    CASE case_id % 4 WHEN 0 THEN ['Disk_full', 'No_such_key'] WHEN 1 THEN []::VARCHAR[] ELSE key_evidence END key_evidence,
    CASE WHEN case_id % 2 = 0 THEN '' ELSE 'Problem of case ' || case_id END problem,
    CASE WHEN case_id % 8 = 1 THEN NULL ELSE 'Raise the limit.' END mitigation,
    CASE WHEN case_id % 4 = 0 THEN []::VARCHAR[] ELSE ['Heap too small', ' skew ', ''] END hypotheses,
    CASE WHEN case_id % 3 = 0 THEN ['SKEW', 'Spot loss'] ELSE cases.suggested END suggested_hypotheses FROM cases),
ee AS (SELECT case_id, pattern, count, '' sample FROM cev
       UNION ALL SELECT case_id, 'CRITICAL_ERROR_TOOL', 1, 'The tool failed for case ' || case_id FROM cases WHERE case_id % 11 = 0),
bad AS (SELECT case_id, pattern, sample FROM ee WHERE contains(pattern, 'CRITICAL_ERROR') OR contains(pattern, 'error_no')
        UNION ALL SELECT case_id, 'CRITICAL_ERROR_NO_LOGS_PATH', '[CRITICAL ERROR] No logs path provided in the initial state.' FROM ec WHERE trim(logs_path) = ''
        UNION ALL SELECT case_id, 'error_no_keywords', '[ERROR] No keywords provided for search. Path: ' || logs_path FROM ec
                  WHERE trim(logs_path) <> '' AND len(keywords) = 0),
draft AS (SELECT case_id, 'System Configuration Error: Unable to perform analysis due to missing or invalid inputs.' problem,
    'Root Cause: ' || string_agg(sample, chr(10) || chr(10) ORDER BY pattern) rca,
    '1. Verify that ''logs_path'' is provided in the initial state' || chr(10) || '2. Ensure logs_path points to a valid Unity Catalog volume path' || chr(10)
    || '3. Check that the path is accessible and contains Spark log files' || chr(10) || '4. Re-run the analysis with correct configuration' mitigation,
    0.0 confidence FROM bad GROUP BY case_id)"""


@register("case_input_errors_edges", EDGE + """
SELECT ec.case_id, bad.case_id IS NOT NULL has_input_error FROM ec LEFT JOIN (
  SELECT case_id FROM bad UNION SELECT case_id FROM ec WHERE len(keywords) = 0) bad USING (case_id)""")
def case_input_errors_edges(spark, sf):
    return C.input_errors(FX.edge_cases(spark, sf), FX.edge_evidence(spark, sf)).select("case_id", "has_input_error")


@register("case_diagnostic_draft", EDGE + " SELECT * FROM draft")
def case_diagnostic_draft(spark, sf):
    return C.diagnostic_draft(FX.edge_cases(spark, sf), FX.edge_evidence(spark, sf))


@register("case_needs_gc_edges", EDGE + """
SELECT case_id, len(list_filter(list_concat(existing, suggested), lambda k: regexp_matches(lower(k), 'gc|heap|memory|oom|pause'))) > 0 needs_gc FROM ec""")
def case_needs_gc_edges(spark, sf):
    return C.needs_gc(FX.edge_cases(spark, sf))


@register("claim_confidence_edges", EDGE + """,
m AS (SELECT case_id, len(regexp_extract_all(rca, '\\[PROVEN\\]')) p, len(regexp_extract_all(rca, '\\[INFERRED\\]')) i FROM ec)
SELECT case_id, CAST(p AS INTEGER) proven, CAST(p + i AS INTEGER) claims, CASE WHEN p + i > 0 THEN round_even(p / (p + i), 2) ELSE 0.0 END claim_confidence FROM m""")
def claim_confidence_edges(spark, sf):
    return C.claim_confidence(FX.edge_cases(spark, sf))


@register("case_loop_done_edges", EDGE + """,
g AS (SELECT case_id, analyze_parse_loops + 1 loops, existing, list_concat(['ERROR', 'Exception', 'Executor lost', 'OutOfMemoryError', 'GC overhead',
        'Container exited'], suggested) g FROM ec),
n AS (SELECT case_id, loops, len(list_distinct([lower(x) FOR x IN g IF NOT list_contains([lower(y) FOR y IN existing], lower(x))])) n FROM g)
SELECT case_id, loops, CAST(n AS BIGINT) n_new, loops >= 6 OR (n = 0 AND loops > 1) analyzer_satisfied FROM n""")
def case_loop_done_edges(spark, sf):
    cs = FX.edge_cases(spark, sf)
    return C.loop_done(cs, C.keyword_new(cs))


@register("report_evidence_edges", EDGE + """,
cl2 AS (SELECT case_id, generate_subscripts(key_evidence, 1) o, unnest(key_evidence) k FROM ec),
m AS (SELECT cl2.case_id, pattern, count, o FROM cl2 JOIN cev ON cev.case_id = cl2.case_id AND cev.pattern = k),
rk AS (SELECT case_id, pattern, count, row_number() OVER (PARTITION BY case_id ORDER BY count DESC, pattern) o FROM cev)
SELECT case_id, CAST(o AS BIGINT) pos, pattern, count FROM m
UNION ALL SELECT rk.case_id, o, pattern, count FROM rk JOIN ec USING (case_id) WHERE len(key_evidence) > 0 AND case_id NOT IN (SELECT case_id FROM m)
UNION ALL SELECT rk.case_id, o, pattern, count FROM rk JOIN ec USING (case_id) WHERE len(key_evidence) = 0 AND o <= 5""")
def report_evidence_edges(spark, sf):
    return C.report_evidence(FX.edge_cases(spark, sf), FX.case_evidence(spark, sf))


_HYP = """,
hyp AS (SELECT case_id, [trim(x) FOR x IN list_concat(hypotheses, suggested_hypotheses) IF trim(x) <> ''] h FROM ec),
hy AS (SELECT case_id, [x FOR x, i IN h IF NOT list_contains([lower(y) FOR y IN h[1:i - 1]], lower(x))] hypotheses FROM hyp)"""


@register("hypotheses_union", EDGE + _HYP + " SELECT case_id, nullif(array_to_string(hypotheses, '|'), '') hypotheses FROM hy")
def hypotheses_union(spark, sf):
    return C.hypotheses_union(FX.edge_cases(spark, sf)).select("case_id", joined("hypotheses").alias("hypotheses"))


@register("case_record", EDGE + _HYP + """,
cr AS (SELECT case_id, trim(critic_reasons) reasons, critic_approve, greatest(0.0, least(1.0, coalesce(confidence, 0.5) + greatest(-0.25, least(0.25, coalesce(critic_adjust, 0.0))))) conf FROM ec),
al AS (SELECT case_id, iteration it, last_status st, critic_approved ok, confidence c0, lower(trim(proposed_action)) prop,
   CASE WHEN iteration = 0 THEN ['reasoning'] WHEN last_status = 'summarized' AND NOT critic_approved THEN ['critic', 'reasoning']
        WHEN critic_approved THEN ['end', 'reasoning'] ELSE ['reasoning'] END allowed FROM ec),
nx AS (SELECT case_id, it, CASE WHEN it >= 6 AND st <> '' THEN 'end' WHEN list_contains(allowed, prop) THEN prop WHEN it = 0 THEN 'reasoning'
   WHEN st = 'summarized' AND NOT ok THEN 'critic' WHEN ok AND c0 >= 0.75 THEN 'end' ELSE 'reasoning' END nxt FROM al),
gen AS (SELECT case_id, existing, list_concat(['ERROR', 'Exception', 'Executor lost', 'OutOfMemoryError', 'GC overhead', 'Container exited'], suggested) g FROM ec),
gd AS (SELECT case_id, existing, [x FOR x, i IN g IF NOT list_contains([lower(y) FOR y IN g[1:i - 1]], lower(x))][1:15] g FROM gen),
mg AS (SELECT case_id, list_concat(existing, g) g FROM gd),
kw AS (SELECT case_id, [x FOR x, i IN g IF NOT list_contains([lower(y) FOR y IN g[1:i - 1]], lower(x))] keywords FROM mg),
em AS (SELECT case_id, string_agg(pattern || '=' || count, '|' ORDER BY count DESC, pattern) evidence_map FROM ee GROUP BY case_id)
SELECT ec.case_id, coalesce(draft.problem, nullif(ec.problem, ''), 'Problem: (unspecified)') problem,
  coalesce(draft.rca, nullif(trim(ec.rca), ''), 'RCA: (unspecified)') rca, coalesce(draft.mitigation, ec.mitigation, 'Mitigation: (unspecified)') mitigation,
  coalesce(draft.confidence, conf) confidence, CASE WHEN nxt = 'reasoning' THEN it + 1 ELSE it END iterations, cr.critic_approve AND conf >= 0.6 critic_approved,
  CASE WHEN conf < 0.6 AND reasons = '' THEN 'Confidence is too low (< 0.6). Please gather more evidence or refine the hypothesis.'
       WHEN conf < 0.6 THEN 'Confidence too low (' || format('{:.2f}', conf) || '). ' || reasons ELSE reasons END critique,
  nxt next_action, array_to_string(kw.keywords, '|') keywords, nullif(array_to_string(hy.hypotheses, '|'), '') hypotheses, em.evidence_map
FROM ec JOIN cr USING (case_id) JOIN nx USING (case_id) JOIN kw USING (case_id) JOIN hy USING (case_id)
LEFT JOIN draft USING (case_id) LEFT JOIN em USING (case_id)""")
def case_record(spark, sf):
    cs, ev = FX.edge_cases(spark, sf), FX.edge_evidence(spark, sf)
    r = R.case_record(cs, C.critic_gate(cs), C.next_action(cs), C.keyword_union(cs), C.hypotheses_union(cs), C.diagnostic_draft(cs, ev), ev)
    shown = F.transform("evidence_map", lambda x: F.concat(x["pattern"], F.lit("="), x["count"].cast("string")))
    return r.select(*[c for c in r.columns if c not in ("keywords", "hypotheses", "evidence_map")], joined("keywords").alias("keywords"),
                    joined("hypotheses").alias("hypotheses"), joined(shown).alias("evidence_map"))


@register("search_payload", _EV_CLASS_SQL + f""",
e AS (SELECT {_EV_COLS} FROM ev),
t AS (SELECT *, string_split(timestamps, '|') ts, string_split(files, '|') fs, string_split(variables, '|') vs, string_split(sample_lines, '|')[1] s FROM e),
p AS (SELECT pattern, count, chr(10) || chr(10) || '**' || pattern || '**: ' || count || ' occurrences across ' || len(fs) || ' files'
  || coalesce(chr(10) || '  - Time range: ' || CASE WHEN len(ts) > 1 THEN ts[1] || ' ... ' || ts[len(ts)] ELSE ts[1] END, '')
  || coalesce(chr(10) || '  - Variables: ' || array_to_string(vs[1:5], ', '), '')
  || coalesce(chr(10) || '  - Sample: `' || CASE WHEN length(s) > 150 THEN s[1:150] || '...' ELSE s END || '`', '') part FROM t)
SELECT CAST(coalesce(sum(count), 0) AS BIGINT) total_matches, string_agg(pattern, '|' ORDER BY count DESC, pattern) patterns_found,
  coalesce('**Evidence Summary:**' || chr(10) || string_agg(part, '' ORDER BY count DESC, pattern), 'No evidence collected') evidence_summary FROM p""")
def search_payload(spark, sf):
    p = R.search_payload(E.evidence_by_class(FX.log_lines(spark, sf)))
    return p.select("total_matches", joined("patterns_found").alias("patterns_found"), "evidence_summary")


# ---------------------------------------------------------------------- GC --
_GC_EDGE_LINES = O.BASE + """,
gl AS (SELECT '/Volumes/logs/service=executor/executor-10.' || (user_id // 60000) || '.' || ((user_id // 250) % 240) || '.' || (user_id % 250) || '.log' path,
  event_id line_no, '[' || event_id || '.5s][info][gc] GC(' || event_id || ') ' || CASE
     WHEN event_type = 'error' AND (user_id % 3 > 0 OR v % 4 = 0) AND user_id % 2 = 0 THEN 'Pause Full (Full GC) '
     WHEN event_type = 'error' AND (user_id % 3 > 0 OR v % 4 = 0) THEN 'Pause Full (System.gc()) '
     WHEN event_type = 'signup' THEN 'Pause Remark ' WHEN event_type = 'purchase' THEN 'Pause Cleanup '
     WHEN event_type = 'view' AND v % 2 = 0 THEN 'Concurrent Mark Cycle ' WHEN event_type = 'view' THEN 'Something else entirely, named at length '
     ELSE 'Pause Young (Normal) (G1 Evacuation Pause) ' END
  || CASE user_id % 5 WHEN 0 THEN '500M->480M(512M) ' WHEN 1 THEN '90000K->30000K(524288K) ' WHEN 2 THEN '1.5G->0.5G(2G) '
     ELSE (100 + v % 400) || 'M->' || (v % 200) || 'M(512M) ' END
  || CASE user_id % 4 WHEN 0 THEN (v % 2000) || '.5ms' WHEN 1 THEN '0.' || lpad(CAST(v % 900 AS VARCHAR), 3, '0') || 's' ELSE (v % 900) || 'ms' END line_text
  FROM b)"""


def _edges(sql: str) -> str:
    assert O.GC_LINES in sql
    return sql.replace(O.GC_LINES, _GC_EDGE_LINES)


def _edge_events(spark, sf, **options):
    return GC.gc_parse(FX.gc_edge_lines(spark, sf), **options)


@register("gc_parse_edges", _edges(GE) + f"\nSELECT {', '.join(chr(34) + c + chr(34) for c in GC.GC_COLUMNS)} FROM gev")
def gc_parse_edges(spark, sf):
    return _edge_events(spark, sf)


@register("gc_parse_full_gc_edges", _edges(GE).replace("FROM gl),\ngg AS", "FROM gl WHERE contains(line_text, 'Full GC')),\ngg AS") + """
SELECT line_no, kind, cause FROM gev""")
def gc_parse_full_gc_edges(spark, sf):
    return _edge_events(spark, sf, prefilter="Full GC").select("line_no", "kind", "cause")


@register("gc_health_edges", f"SELECT executor_ip, full_gc_count, max_heap_used_pct, max_duration_sec, health_status, health_issues FROM ({_edges(GC_BY_EXEC_SQL)}) bx")
def gc_health_edges(spark, sf):
    h = GC.gc_by_executor(_edge_events(spark, sf))
    return h.select("executor_ip", F.col("full_gc_count").cast("bigint").alias("full_gc_count"), "max_heap_used_pct", "max_duration_sec",
                    "health_status", joined("health_issues").alias("health_issues"))
