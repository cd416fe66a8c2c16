"""Registered queries: name -> (spark builder, oracle SQL).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
derived input; list-valued columns are rendered as ``|``-joined strings (NULL
when empty) so both engines hash the same values.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import search as S
from ..sources import fixtures as FX
from . import oracle as O
from .oracle import q

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def joined(c, sep: str = "|") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.size(c) > 0, F.array_join(c, sep))


def render_evidence(ev: DataFrame) -> DataFrame:
    return ev.select(*[joined(c).alias(c) if c in E.EVIDENCE_FIELDS else F.col(c)
                       for c in ev.columns])


# ------------------------------------------------------------------ search --
GREP_ANY = ["OutOfMemoryError", r"Lost executor \d+"]
GREP_ALL = ["ERROR", r"stage [12]\.0"]
GREP_FIXED = ["0xab", "(TID 1"]
GREP_ICASE = ["fetchfailed", "lost EXECUTOR"]
GREP_SPANS = [r"\d+\.0", "ERROR"]
GREP_WHICH = ["ERROR", "WARN", "FetchFailed", r"executor \d"]
GREP_DOCS = ["avec", " pour "]

LL = "WITH " + O.LOG_LINES


@register("grep_any", LL + f"""
SELECT path, line_no, line_text FROM ll
WHERE regexp_matches(line_text, {q('|'.join(f'(?:{p})' for p in GREP_ANY))})""")
def grep_any(spark, sf):
    return S.grep(FX.log_lines(spark, sf), GREP_ANY)


@register("grep_all", LL + f"""
SELECT path, line_no, line_text FROM ll
WHERE {' AND '.join(f'regexp_matches(line_text, {q(p)})' for p in GREP_ALL)}""")
def grep_all(spark, sf):
    return S.grep(FX.log_lines(spark, sf), GREP_ALL, mode="all")


@register("grep_fixed", LL + f"""
SELECT path, line_no, line_text FROM ll
WHERE {' OR '.join(f'contains(line_text, {q(p)})' for p in GREP_FIXED)}""")
def grep_fixed(spark, sf):
    return S.grep(FX.log_lines(spark, sf), GREP_FIXED, fixed=True)


@register("grep_ignore_case", LL + f"""
SELECT path, line_no, line_text FROM ll
WHERE regexp_matches(line_text, {q('|'.join(f'(?:{p})' for p in GREP_ICASE))}, 'i')""")
def grep_ignore_case(spark, sf):
    return S.grep(FX.log_lines(spark, sf), GREP_ICASE, ignore_case=True)


_SPAN_RX = "|".join(f"(?:{p})" for p in GREP_SPANS)


@register("grep_spans", LL + f""",
m AS (SELECT path, line_no,
        string_split(regexp_replace(line_text, {q(_SPAN_RX)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) parts
      FROM ll WHERE regexp_matches(line_text, {q(_SPAN_RX)}))
SELECT path, line_no, CAST(len(parts) - 1 AS BIGINT) AS n_spans,
  array_to_string(list_transform(range(2, len(parts) + 1), lambda k:
     CAST(length(parts[1]) + coalesce(list_sum(list_transform(parts[2:k-1], lambda x: length(x) - 1)), 0) AS VARCHAR)
     || '-' ||
     CAST(length(parts[1]) + coalesce(list_sum(list_transform(parts[2:k-1], lambda x: length(x) - 1)), 0)
          + length(split_part(parts[k], chr(2), 1)) AS VARCHAR)), '|') AS spans
FROM m""")
def grep_spans(spark, sf):
    g = S.grep(FX.log_lines(spark, sf), GREP_SPANS, with_spans=True)
    return g.select("path", "line_no", F.size("spans").cast("bigint").alias("n_spans"),
                    T.spans_text("spans").alias("spans"))


@register("grep_which", LL + f"""
SELECT path, line_no, concat_ws('|', {', '.join(f"CASE WHEN regexp_matches(line_text, {q(p)}) THEN {q(p)} END" for p in GREP_WHICH)}) AS which
FROM ll WHERE regexp_matches(line_text, {q('|'.join(f'(?:{p})' for p in GREP_WHICH))})""")
def grep_which(spark, sf):
    g = S.grep(FX.log_lines(spark, sf), GREP_WHICH, return_which=True)
    return g.select("path", "line_no", F.array_join("which", "|").alias("which"))


@register("grep_limit", LL + """
SELECT path, line_no, line_text FROM ll WHERE regexp_matches(line_text, 'INFO')
ORDER BY path, line_no LIMIT 100""")
def grep_limit(spark, sf):
    return S.grep(FX.log_lines(spark, sf), ["INFO"], limit=100)


@register("grep_documents", "WITH " + O.DOC_LINES + f"""
SELECT path, line_no, line_text FROM dl
WHERE regexp_matches(line_text, {q('|'.join(f'(?:{p})' for p in GREP_DOCS))})""")
def grep_documents(spark, sf):
    return S.grep(FX.doc_lines(spark, sf), GREP_DOCS)


# ------------------------------------------------------------- projections --
@register("classify_lines", LL + f"""
SELECT ll.path, ll.line_no, c.pattern FROM ll JOIN {O.class_values()}
  ON regexp_matches(ll.line_text, c.rx, 'i')""")
def classify_lines(spark, sf):
    return FX.log_lines(spark, sf).select(
        "path", "line_no", F.explode(T.class_labels("line_text")).alias("pattern"))


_LOG_AND_GC = "WITH " + O.GC_LINES + """,
ll AS (SELECT * FROM (""" + O.LOG_LINES.split("ll AS (", 1)[1] + """
), xl AS (SELECT 'log' src, * FROM ll UNION ALL SELECT 'gc' src, * FROM gl)"""


def _log_and_gc(spark, sf):
    return (FX.log_lines(spark, sf).select(F.lit("log").alias("src"), "*")
            .unionByName(FX.gc_lines(spark, sf).select(F.lit("gc").alias("src"), "*")))


@register("extract_timestamp", _LOG_AND_GC + f"""
SELECT src, line_no, {O.full_ts('line_text')} AS ts FROM xl""")
def extract_timestamp(spark, sf):
    return _log_and_gc(spark, sf).select("src", "line_no",
                                         T.extract_timestamp("line_text").alias("ts"))


@register("extract_short_ts", _LOG_AND_GC + f"""
SELECT src, line_no, {O.short_ts('line_text')} AS ts FROM xl""")
def extract_short_ts(spark, sf):
    return _log_and_gc(spark, sf).select("src", "line_no",
                                         T.extract_short_ts("line_text").alias("ts"))


@register("normalize_pattern", LL + f"""
SELECT line_no, {O.normalize('line_text')} AS template FROM ll""")
def normalize_pattern(spark, sf):
    return FX.log_lines(spark, sf).select("line_no",
                                          T.normalize_pattern("line_text").alias("template"))


@register("error_pattern", LL + f"""
SELECT line_no, {O.error_pattern('line_text', True)} AS pattern FROM ll""")
def error_pattern(spark, sf):
    return FX.log_lines(spark, sf).select(
        "line_no", T.error_pattern("line_text", strip_prefix=True).alias("pattern"))


@register("error_pattern_compat", LL + f"""
SELECT line_no, {O.error_pattern('line_text', False)} AS pattern FROM ll""")
def error_pattern_compat(spark, sf):
    return FX.log_lines(spark, sf).select(
        "line_no", T.error_pattern("line_text", strip_prefix=False).alias("pattern"))


@register("extract_variables", LL + """,
v AS (""" + O.variables_rows("ll", key="line_no AS k") + """)
SELECT l AS line_no, string_agg(v, '|' ORDER BY i) AS variables FROM v GROUP BY l""")
def extract_variables(spark, sf):
    x = FX.log_lines(spark, sf).select("line_no", T.extract_variables("line_text").alias("a"))
    return x.where(F.size("a") > 0).select("line_no", F.array_join("a", "|").alias("variables"))


@register("typed_variables", LL + """,
v AS (""" + O.typed_vars_rows("ll", key="line_no AS k") + """)
SELECT l AS line_no, string_agg(v, '|' ORDER BY i) AS variables FROM v GROUP BY l""")
def typed_variables(spark, sf):
    x = FX.log_lines(spark, sf).select("line_no", T.typed_variables("line_text").alias("a"))
    return x.where(F.size("a") > 0).select("line_no", F.array_join("a", "|").alias("variables"))


@register("content_key", LL + """
SELECT line_no, substr(md5(line_text), 1, 12) AS k FROM ll""")
def content_key(spark, sf):
    return FX.log_lines(spark, sf).select("line_no", T.content_key("line_text").alias("k"))


# --------------------------------------------------------------- evidence --
_EV_COLS = ("pattern, count, timestamps, files, sample_lines, variables, "
            "n_timestamps, n_files, n_variables, first_path, first_line_no")

_EV_CLASS_SQL = LL + f""",
keyed AS (SELECT ll.*, c.pattern FROM ll JOIN {O.class_values()} ON regexp_matches(ll.line_text, c.rx, 'i')),
facts AS (
  SELECT pattern, 'ts' f, {O.short_ts('line_text')} v, path p, line_no l, 0 i FROM keyed
  UNION ALL SELECT pattern, 'file' f, path v, path p, line_no l, 0 i FROM keyed
  UNION ALL {O.typed_vars_rows('keyed')}),
{O.first_k_lists('facts', {'timestamps': ('ts', 10, 'value'), 'files': ('file', 5, 'value'),
                           'variables': ('var', 10, 'value')})},
samples AS (
  SELECT pattern, string_agg(line_text, '|' ORDER BY path, line_no) sample_lines FROM (
    SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY path, line_no) r FROM keyed) WHERE r <= 3
  GROUP BY pattern),
cnt AS (
  SELECT pattern, CAST(count(*) AS BIGINT) count, arg_min(path, (path, line_no)) first_path,
         arg_min(line_no, (path, line_no)) first_line_no FROM keyed GROUP BY pattern),
ev AS (
  SELECT cnt.pattern, count, timestamps, files, sample_lines, variables,
    coalesce(n_timestamps, 0) n_timestamps, coalesce(n_files, 0) n_files,
    coalesce(n_variables, 0) n_variables, first_path, first_line_no
  FROM cnt LEFT JOIN lists USING (pattern) LEFT JOIN samples USING (pattern))"""


def _ev_template_sql(strip_prefix: bool, where: str = "true", whole: bool = False) -> str:
    ts_k, files_k, vars_k = (None, None, None) if whole else (10, 5, 20)
    return LL + f""",
keyed AS (SELECT * FROM (SELECT *, {O.error_pattern('line_text', strip_prefix)} AS pattern FROM ll
          WHERE {O.strip('line_text')} <> '' AND ({where})) WHERE pattern <> ''),
facts AS (
  SELECT pattern, 'ts' f, {O.full_ts('line_text')} v, path p, line_no l, 0 i FROM keyed
  UNION ALL SELECT pattern, 'file' f, path v, path p, line_no l, 0 i FROM keyed
  UNION ALL SELECT pattern, 'sample' f, line_text v, path p, line_no l, 0 i FROM keyed
  UNION ALL {O.variables_rows('keyed')}),
{O.first_k_lists('facts', {'timestamps': ('ts', ts_k, 'arrival'), 'files': ('file', files_k, 'arrival'),
                           'sample_lines': ('sample', 3, 'arrival'),
                           'variables': ('var', vars_k, 'arrival')})},
cnt AS (
  SELECT pattern, CAST(count(*) AS BIGINT) count, arg_min(path, (path, line_no)) first_path,
         arg_min(line_no, (path, line_no)) first_line_no FROM keyed GROUP BY pattern),
ev AS (
  SELECT cnt.pattern, count, timestamps, files, sample_lines, variables,
    coalesce(n_timestamps, 0) n_timestamps, coalesce(n_files, 0) n_files,
    coalesce(n_variables, 0) n_variables, first_path, first_line_no
  FROM cnt LEFT JOIN lists USING (pattern))"""


@register("evidence_by_class", _EV_CLASS_SQL + f"\nSELECT {_EV_COLS} FROM ev")
def evidence_by_class(spark, sf):
    return render_evidence(E.evidence_by_class(FX.log_lines(spark, sf)))


@register("evidence_by_template", _ev_template_sql(True, whole=True) + f"\nSELECT {_EV_COLS} FROM ev")
def evidence_by_template(spark, sf):
    return render_evidence(E.evidence_by_template(FX.log_lines(spark, sf), ts_k=None, files_k=None, vars_k=None))


@register("evidence_by_template_compat", _ev_template_sql(False) + f"\nSELECT {_EV_COLS} FROM ev")
def evidence_by_template_compat(spark, sf):
    return render_evidence(E.evidence_by_template(FX.log_lines(spark, sf), strip_prefix=False))


@register("evidence_facts", _ev_template_sql(True) + """,
every AS (
  SELECT * FROM facts WHERE f <> 'sample' AND v IS NOT NULL AND v <> ''
  UNION ALL SELECT pattern, '_n', '', path, line_no, 0 FROM keyed)
SELECT pattern, CASE f WHEN 'ts' THEN 'timestamps' WHEN 'file' THEN 'files' WHEN 'var' THEN 'variables' ELSE 'lines' END field,
       v "value", CAST(count(*) AS BIGINT) n, arg_min(p, (p, l, i)) first_path, arg_min(l, (p, l, i)) first_line_no
FROM every GROUP BY pattern, f, v""")
def evidence_facts(spark, sf):
    return E.evidence_facts(FX.log_lines(spark, sf))


@register("evidence_stats", _ev_template_sql(False) + """
SELECT CAST(count(*) AS BIGINT) total_unique_patterns,
       CAST(coalesce(sum(count), 0) AS BIGINT) total_occurrences,
       (SELECT CAST(count(DISTINCT path) AS BIGINT) FROM keyed) total_files,
       CAST(CASE WHEN count(*) > 0 THEN floor(sum(count) / count(*)) ELSE 0 END AS BIGINT)
         avg_occurrences_per_pattern
FROM ev""")
def evidence_stats(spark, sf):
    return E.facts_stats(E.evidence_facts(FX.log_lines(spark, sf), strip_prefix=False))


@register("evidence_totals", LL + f""",
keyed AS (SELECT ll.line_no, c.pattern FROM ll JOIN {O.class_values()} ON regexp_matches(ll.line_text, c.rx, 'i'))
SELECT CAST(count(*) AS BIGINT) label_matches, CAST(count(DISTINCT line_no) AS BIGINT) line_matches,
       array_to_string(list_sort(list_distinct(list(pattern))), '|') patterns_found FROM keyed""")
def evidence_totals(spark, sf):
    t = E.evidence_totals(FX.log_lines(spark, sf))
    return t.select("label_matches", "line_matches",
                    F.array_join("patterns_found", "|").alias("patterns_found"))


@register("evidence_top", _ev_template_sql(False) + f"""
SELECT {_EV_COLS}, CAST(row_number() OVER (ORDER BY count DESC, pattern) AS INTEGER) AS rank,
       CAST(greatest((SELECT count(*) FROM ev) - 10, 0) AS BIGINT) AS more_patterns
FROM ev ORDER BY count DESC, pattern LIMIT 10""")
def evidence_top(spark, sf):
    ev = E.evidence_by_template(FX.log_lines(spark, sf), strip_prefix=False)
    return render_evidence(E.evidence_top(ev, 10))


@register("evidence_class_top", _EV_CLASS_SQL + f"""
SELECT {_EV_COLS}, CAST(row_number() OVER (ORDER BY count DESC, pattern) AS INTEGER) AS rank,
       CAST(greatest((SELECT count(*) FROM ev) - 5, 0) AS BIGINT) AS more_patterns
FROM ev ORDER BY count DESC, pattern LIMIT 5""")
def evidence_class_top(spark, sf):
    return render_evidence(E.evidence_top(E.evidence_by_class(FX.log_lines(spark, sf)), 5))


# evidence_merge: the class maps of driver files and of executor files, merged
_MERGE_PART = """
keyed{n} AS (SELECT ll.*, c.pattern FROM ll JOIN {cv} ON regexp_matches(ll.line_text, c.rx, 'i')
             WHERE {cond}),"""


def _merge_sql() -> str:
    parts = []
    for n, cond in ((0, "contains(path, 'driver')"), (1, "NOT contains(path, 'driver')")):
        facts_n = f"""facts{n} AS (
  SELECT pattern, 'ts' f, {O.short_ts('line_text')} v, path p, line_no l, 0 i FROM keyed{n}
  UNION ALL SELECT pattern, 'file' f, path v, path p, line_no l, 0 i FROM keyed{n}
  UNION ALL {O.typed_vars_rows(f'keyed{n}')}),"""
        parts.append(_MERGE_PART.format(n=n, cv=O.class_values(), cond=cond) + facts_n)
    # per map: first 10 ts / 5 files / 10 vars by value, 3 first samples
    maps = []
    for n in (0, 1):
        maps.append(f"""
dd{n} AS (SELECT DISTINCT pattern, f, v FROM facts{n} WHERE v IS NOT NULL AND v <> ''),
rk{n} AS (SELECT *, row_number() OVER (PARTITION BY pattern, f ORDER BY v) rn FROM dd{n}),
lim{n} AS (SELECT {n} seq, pattern, f, v, 0 rn FROM rk{n}
           WHERE (f = 'ts' AND rn <= 10) OR (f = 'file' AND rn <= 5) OR (f = 'var' AND rn <= 10)
           UNION ALL
           SELECT {n} seq, pattern, 'sample' f, line_text v, r rn FROM (
             SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY path, line_no) r FROM keyed{n})
           WHERE r <= 3),
cnt{n} AS (SELECT pattern, count(*) c FROM keyed{n} GROUP BY pattern),""")
    return (LL + "," + "".join(parts) + "".join(maps) + """
u AS (SELECT * FROM lim0 UNION ALL SELECT * FROM lim1),
dv AS (SELECT DISTINCT pattern, f, v FROM u WHERE f <> 'sample'),
rv AS (SELECT *, row_number() OVER (PARTITION BY pattern, f ORDER BY v) r FROM dv),
rs AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY seq, rn) r FROM u WHERE f = 'sample'),
cnt AS (SELECT pattern, CAST(sum(c) AS BIGINT) count FROM
        (SELECT * FROM cnt0 UNION ALL SELECT * FROM cnt1) GROUP BY pattern)
SELECT cnt.pattern, count,
  (SELECT string_agg(v, '|' ORDER BY v) FROM rv WHERE rv.pattern = cnt.pattern AND f = 'ts' AND r <= 10) timestamps,
  (SELECT string_agg(v, '|' ORDER BY v) FROM rv WHERE rv.pattern = cnt.pattern AND f = 'file' AND r <= 5) files,
  (SELECT string_agg(v, '|' ORDER BY r) FROM rs WHERE rs.pattern = cnt.pattern AND r <= 3) sample_lines,
  (SELECT string_agg(v, '|' ORDER BY v) FROM rv WHERE rv.pattern = cnt.pattern AND f = 'var' AND r <= 10) variables
FROM cnt""")


@register("evidence_merge", _merge_sql())
def evidence_merge(spark, sf):
    ll = FX.log_lines(spark, sf)
    drv = F.col("path").contains("driver")
    a = E.evidence_by_class(ll.where(drv))
    b = E.evidence_by_class(ll.where(~drv))
    return render_evidence(E.evidence_merge(a, b))


# evidence over repeated searches: hit sets overlap, a line counts once
SEARCHES = [["ERROR"], ["Exception"], [r"Lost executor \d+"], ["ERROR", "WARN"]]


@register("evidence_incremental", _ev_template_sql(True, " OR ".join(
    f"regexp_matches(line_text, {q(p)})" for s in SEARCHES for p in s)) + f"\nSELECT {_EV_COLS} FROM ev")
def evidence_incremental(spark, sf):
    ll = FX.log_lines(spark, sf)
    return render_evidence(E.evidence_from_searches([S.grep(ll, s) for s in SEARCHES]))
