"""Source, case and report queries of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import cases as C
from ..sources import fixtures as FX
from ..sources import json_text as J
from ..sources.tables import table
from . import oracle as O
from .catalog import joined, register
from .oracle import q

WC = "WITH " + O.CASES


# ---------------------------------------------------------------- sources --
@register("hits_from_json", "WITH " + O.LOG_LINES + """
SELECT path, line_no, line_text FROM ll""")
def hits_from_json(spark, sf):
    # the log lines, shipped as JSON arrays (one per chunk of 8 lines), read back
    blobs = FX.json_hit_blobs(spark, sf).select(
        "blob_id", F.regexp_extract("blob", r"(?s)'(\[.*\])'", 1).alias("arr"))
    return J.hits_from_json(blobs, "arr").select("path", "line_no", "line_text")


@register("extract_json_array", "WITH " + O.LOG_LINES + """
SELECT path, line_no, line_text FROM ll""")
def extract_json_array(spark, sf):
    return J.hits_from_blob(FX.json_hit_blobs(spark, sf), "blob").select(
        "path", "line_no", "line_text")


_SPLIT = "regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')"


@register("lines_from_blob", f"""
WITH p AS (SELECT doc_id, CASE WHEN text = '' THEN []::VARCHAR[] ELSE {_SPLIT} END a FROM documents),
t AS (SELECT doc_id, CASE WHEN len(a) > 0 AND a[len(a)] = '' THEN a[1:len(a)-1] ELSE a END a FROM p)
SELECT doc_id, CAST(generate_subscripts(a, 1) AS BIGINT) line_no, unnest(a) line_text FROM t""")
def lines_from_blob(spark, sf):
    return J.lines_from_blob(table(spark, sf, "documents"), "text", keep=["doc_id"]).select(
        "doc_id", "line_no", "line_text")


@register("user_context", """
SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn)
    FILTER (WHERE role = 'user' AND text <> ''), '') user_context
FROM conversations GROUP BY conv_id""")
def user_context(spark, sf):
    return J.user_context(table(spark, sf, "conversations"))


_TJ_TEXT = """CASE event_type WHEN 'click' THEN props WHEN 'view' THEN 'Found ' || props || ' end'
  WHEN 'error' THEN 'broken ' || replace(props, '}', '') WHEN 'signup' THEN '{"outer": ' || props || '} tail'
  ELSE 'prefix ' || props END"""


def _tj_text():
    et, pr = F.col("event_type"), F.col("props")
    return (F.when(et == "click", pr)
            .when(et == "view", F.concat(F.lit("Found "), pr, F.lit(" end")))
            .when(et == "error", F.concat(F.lit("broken "), F.replace(pr, F.lit("}"), F.lit(""))))
            .when(et == "signup", F.concat(F.lit('{"outer": '), pr, F.lit("} tail")))
            .otherwise(F.concat(F.lit("prefix "), pr)))


@register("tolerant_json", f"""
WITH t AS (SELECT event_id, {_TJ_TEXT} AS s FROM events),
u AS (SELECT event_id, s, CASE WHEN strpos(s, '{{') > 0 AND strpos(s, '}}') > 0
        AND length(s) - strpos(reverse(s), '}}') + 1 > strpos(s, '{{')
        THEN substr(s, strpos(s, '{{'), length(s) - strpos(reverse(s), '}}') + 1 - strpos(s, '{{') + 1) END inner_s FROM t),
j AS (SELECT event_id, CASE WHEN json_valid(s) THEN s WHEN json_valid(inner_s) THEN inner_s END js FROM u)
SELECT event_id, js IS NOT NULL parsed,
  coalesce(TRY_CAST(json_extract(js, '$.k') AS BIGINT), TRY_CAST(json_extract(js, '$.outer.k') AS BIGINT)) k
FROM j""")
def tolerant_json(spark, sf):
    v = T.tolerant_json(_tj_text())
    return table(spark, sf, "events").select(
        "event_id", v.isNotNull().alias("parsed"),
        F.coalesce(F.try_variant_get(v, "$.k", "bigint"),
                   F.try_variant_get(v, "$.outer.k", "bigint")).alias("k"))


# ------------------------------------------------------------------ cases --
@register("claim_confidence", WC + """,
m AS (SELECT case_id, CAST((length(rca) - length(replace(rca, '[PROVEN]', ''))) / 8 AS INTEGER) proven,
        CAST((length(rca) - length(replace(rca, '[INFERRED]', ''))) / 10 AS INTEGER) inferred FROM cases)
SELECT case_id, proven, proven + inferred claims,
  CASE WHEN proven + inferred > 0 THEN round_even(proven / (proven + inferred), 2) ELSE 0.0 END claim_confidence
FROM m""")
def claim_confidence(spark, sf):
    return C.claim_confidence(FX.cases(spark, sf))


@register("critic_gate", WC + f""",
g AS (SELECT case_id, critic_approve, {O.strip("coalesce(critic_reasons, '')")} reasons,
        greatest(0.0, least(1.0, coalesce(confidence, 0.5) + greatest(-0.25, least(0.25, coalesce(critic_adjust, 0.0))))) conf
      FROM cases)
SELECT case_id, critic_approve AND conf >= 0.6 critic_approved,
  CASE WHEN conf < 0.6 AND reasons = '' THEN {q(P.CRITIC_LOW_DEFAULT)}
       WHEN conf < 0.6 THEN 'Confidence too low (' || {O.fmt('conf', 2)} || '). ' || reasons
       ELSE reasons END critique, conf confidence
FROM g""")
def critic_gate(spark, sf):
    return C.critic_gate(FX.cases(spark, sf))


@register("case_next_action", WC + f""",
a AS (SELECT case_id, iteration it, coalesce(last_status, '') st, coalesce(critic_approved, false) ok, confidence conf,
        lower({O.strip("coalesce(proposed_action, '')")}) prop,
        CASE WHEN iteration = 0 THEN ['reasoning']
             WHEN coalesce(last_status, '') = 'summarized' AND NOT coalesce(critic_approved, false) THEN ['critic', 'reasoning']
             WHEN coalesce(critic_approved, false) THEN ['end', 'reasoning'] ELSE ['reasoning'] END allowed
      FROM cases),
n AS (SELECT *, CASE WHEN it >= 6 AND st <> '' THEN 'end' WHEN list_contains(allowed, prop) THEN prop
        WHEN it = 0 THEN 'reasoning' WHEN st = 'summarized' AND NOT ok THEN 'critic'
        WHEN ok AND conf >= 0.75 THEN 'end' ELSE 'reasoning' END nxt FROM a)
SELECT case_id, array_to_string(allowed, '|') allowed_actions, nxt next_action,
  CASE WHEN nxt = 'reasoning' THEN it + 1 ELSE it END new_iteration FROM n""")
def case_next_action(spark, sf):
    return C.next_action(FX.cases(spark, sf))


_DEFAULTS = "[" + ", ".join(q(k) for k in P.DEFAULT_KEYWORDS) + "]"
_KU = WC + f""",
ku AS (SELECT case_id, existing, {O.dedupe_keep_order(f'list_concat({_DEFAULTS}, suggested)')}[1:15] generated FROM cases),
ku2 AS (SELECT case_id, existing, generated, {O.dedupe_keep_order('list_concat(existing, generated)')} keywords FROM ku)"""


@register("keyword_union", _KU + """
SELECT case_id, array_to_string(generated, '|') generated, array_to_string(keywords, '|') keywords FROM ku2""")
def keyword_union(spark, sf):
    k = C.keyword_union(FX.cases(spark, sf))
    return k.select("case_id", F.array_join("generated", "|").alias("generated"),
                    F.array_join("keywords", "|").alias("keywords"))


_KN = _KU + """,
kn AS (SELECT case_id, list_filter(generated, lambda k: NOT list_contains(list_transform(existing, lambda e: lower(e)), lower(k))) new_keywords FROM ku2)"""


@register("keyword_new", _KN + """
SELECT case_id, nullif(array_to_string(new_keywords, '|'), '') new_keywords FROM kn""")
def keyword_new(spark, sf):
    k = C.keyword_new(FX.cases(spark, sf))
    return k.select("case_id", joined("new_keywords").alias("new_keywords"))


@register("case_loop_done", _KN + """
SELECT cases.case_id, analyze_parse_loops + 1 loops, CAST(len(new_keywords) AS BIGINT) n_new,
  analyze_parse_loops + 1 >= 6 OR (len(new_keywords) = 0 AND analyze_parse_loops + 1 > 1) analyzer_satisfied
FROM cases JOIN kn USING (case_id)""")
def case_loop_done(spark, sf):
    cs = FX.cases(spark, sf)
    return C.loop_done(cs, C.keyword_new(cs))


@register("case_input_errors", WC + """,
k AS (SELECT case_id, pattern FROM cev
      UNION ALL SELECT case_id, 'CRITICAL_ERROR_NO_LOGS_PATH' FROM cases WHERE trim(logs_path) = ''),
f AS (SELECT case_id, bool_or(contains(pattern, 'CRITICAL_ERROR') OR contains(pattern, 'error_no')) bad FROM k GROUP BY case_id)
SELECT case_id, coalesce(bad, false) has_input_error,
  CASE WHEN bad THEN 'System Configuration Error: Unable to perform analysis due to missing or invalid inputs.' END problem,
  CASE WHEN bad THEN 0.0 END confidence
FROM cases LEFT JOIN f USING (case_id)""")
def case_input_errors(spark, sf):
    cs = FX.cases(spark, sf).withColumn("keywords", F.col("existing"))
    return C.input_errors(cs, FX.case_evidence(spark, sf))


@register("case_needs_gc", WC + f"""
SELECT case_id, len(list_filter(list_concat(existing, suggested), lambda k: regexp_matches(lower(k), {q('|'.join(P.MEMORY_HINTS))}))) > 0 needs_gc
FROM cases""")
def case_needs_gc(spark, sf):
    return C.needs_gc(FX.cases(spark, sf))


_CLAIMS = WC + """,
cl2 AS (SELECT case_id, CAST(generate_subscripts(key_evidence, 1) - 1 AS INTEGER) pos, unnest(key_evidence) "key" FROM cases)"""


@register("claims_supported", _CLAIMS + """
SELECT case_id, pos, "key" FROM cl2 WHERE EXISTS (SELECT 1 FROM cev WHERE cev.case_id = cl2.case_id AND cev.pattern = cl2."key")""")
def claims_supported(spark, sf):
    return C.claims_supported(FX.cases(spark, sf), FX.case_evidence(spark, sf))


@register("claims_unsupported", _CLAIMS + """
SELECT case_id, pos, "key" FROM cl2 WHERE NOT EXISTS (SELECT 1 FROM cev WHERE cev.case_id = cl2.case_id AND cev.pattern = cl2."key")""")
def claims_unsupported(spark, sf):
    return C.claims_unsupported(FX.cases(spark, sf), FX.case_evidence(spark, sf))


_RULES = "(VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in P.DRILLDOWN_RULES) + ") r(symptom, cause, keyword)"


@register("drilldown_keywords", WC + f"""
SELECT DISTINCT cev.case_id, r.symptom, r.cause, r.keyword FROM cev JOIN {_RULES} ON cev.pattern = r.symptom""")
def drilldown_keywords(spark, sf):
    return C.drilldown(FX.case_evidence(spark, sf), C.rules_table(spark))


@register("causal_chain", WC.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
rules AS (SELECT * FROM {_RULES}),
obs AS (SELECT DISTINCT case_id, pattern node FROM cev),
chain(case_id, root, node, depth, path) AS (
  SELECT case_id, node, node, 0, node FROM obs
  UNION ALL
  SELECT c.case_id, c.root, r.cause, c.depth + 1, c.path || ' -> ' || r.cause
  FROM chain c JOIN rules r ON c.node = r.symptom
  WHERE NOT list_contains(string_split(c.path, ' -> '), r.cause))
SELECT case_id, root, node AS cause, depth, path FROM chain WHERE depth > 0""")
def causal_chain(spark, sf):
    return C.causal_chain(spark, FX.case_evidence(spark, sf), C.rules_table(spark))


# Rules learnt from the logs: the user of an error event, and the user of the error event behind it.
_LEARNT_SQL = """WITH RECURSIVE r AS (
  SELECT user_id, lead(user_id) OVER (ORDER BY event_id) nxt FROM events WHERE event_type = 'error'),
e AS (SELECT DISTINCT 'user ' || user_id a, 'user ' || nxt b FROM r WHERE user_id <> nxt AND user_id % 3 > 0),
bfs(a, b, d) USING KEY (a, b) AS (
  SELECT a, b, 1 FROM e
  UNION
  SELECT x.a, e.b, min(x.d) + 1 FROM bfs x JOIN e ON x.b = e.a
  WHERE x.a <> e.b AND NOT EXISTS (SELECT 1 FROM recurring.bfs y WHERE y.a = x.a AND y.b = e.b) GROUP BY x.a, e.b),
via AS (SELECT bfs.a, bfs.b, bfs.d, min(e.a) v FROM bfs JOIN e ON e.b = bfs.b
        LEFT JOIN bfs y ON y.a = bfs.a AND y.b = e.a
        WHERE (e.a = bfs.a AND bfs.d = 1) OR y.d = bfs.d - 1 GROUP BY ALL),
walk(a, b, cur, path) AS (
  SELECT a, b, b, b FROM via
  UNION ALL SELECT w.a, w.b, via.v, via.v || ' -> ' || w.path FROM walk w JOIN via ON via.a = w.a AND via.b = w.cur)
"""


@register("causal_closure", _LEARNT_SQL + """
SELECT via.a root, via.b cause, CAST(via.d AS INTEGER) depth, via.v via, w.path
FROM via JOIN walk w ON w.a = via.a AND w.b = via.b AND w.cur = w.a""")
def causal_closure(spark, sf):
    return C.close_rules(FX.learnt_rules(spark, sf))


@register("report_evidence", WC + """,
cl2 AS (SELECT case_id, generate_subscripts(key_evidence, 1) - 1 o, unnest(key_evidence) "key" FROM cases),
m AS (SELECT cl2.case_id, cl2."key" pattern, cev.count, o FROM cl2 JOIN cev ON cev.case_id = cl2.case_id AND cev.pattern = cl2."key"),
nomatch AS (SELECT case_id FROM cases WHERE len(key_evidence) > 0 AND case_id NOT IN (SELECT case_id FROM m)),
noclaims AS (SELECT case_id FROM cases WHERE len(key_evidence) = 0),
rk AS (SELECT case_id, pattern, count, row_number() OVER (PARTITION BY case_id ORDER BY count DESC, pattern) - 1 o FROM cev),
u AS (SELECT case_id, pattern, count, o FROM m
      UNION ALL SELECT case_id, pattern, count, o FROM rk WHERE case_id IN (SELECT case_id FROM nomatch)
      UNION ALL SELECT case_id, pattern, count, o FROM rk WHERE o < 5 AND case_id IN (SELECT case_id FROM noclaims))
SELECT case_id, CAST(o + 1 AS BIGINT) pos, pattern, count FROM u""")
def report_evidence(spark, sf):
    return C.report_evidence(FX.cases(spark, sf), FX.case_evidence(spark, sf))


@register("case_next_action_strict", WC + f""",
a AS (SELECT case_id, iteration it, coalesce(last_status, '') st, coalesce(critic_approved, false) ok, confidence conf,
        lower({O.strip("coalesce(proposed_action, '')")}) prop,
        CASE WHEN iteration = 0 THEN ['reasoning']
             WHEN coalesce(last_status, '') = 'summarized' AND NOT coalesce(critic_approved, false) THEN ['critic', 'reasoning']
             WHEN coalesce(critic_approved, false) AND confidence >= 0.75 THEN ['end', 'reasoning'] ELSE ['reasoning'] END allowed
      FROM cases),
n AS (SELECT *, CASE WHEN it >= 6 AND st <> '' THEN 'end' WHEN list_contains(allowed, prop) THEN prop
        WHEN it = 0 THEN 'reasoning' WHEN st = 'summarized' AND NOT ok THEN 'critic'
        WHEN ok AND conf >= 0.75 THEN 'end' ELSE 'reasoning' END nxt FROM a)
SELECT case_id, array_to_string(allowed, '|') allowed_actions, nxt next_action,
  CASE WHEN nxt = 'reasoning' THEN it + 1 ELSE it END new_iteration FROM n""")
def case_next_action_strict(spark, sf):
    return C.next_action(FX.cases(spark, sf), strict=True)
