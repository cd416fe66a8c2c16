"""DuckDB SQL for every registered query (the independent oracle).

Written by hand from the operator definitions, not generated from the Spark
plans. Shared pieces (derived fixtures, regex rules) are composed from the
same fixed values as the Spark side so both read one table of rules.
"""

from __future__ import annotations

from ..functions import patterns as P


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- fixtures --
BASE = """b AS (
  SELECT event_id, user_id, ts, event_type, CAST(floor(value*100) AS BIGINT) v,
    '/Volumes/logs/service=' || CASE WHEN user_id%4=0 THEN 'driver/driver'
       ELSE 'executor/executor-10.0.0.' || CAST(user_id%8 AS VARCHAR) END || '.log' AS path
  FROM events)"""

LOG_LINES = BASE + """,
ll AS (
  SELECT path, event_id AS line_no, strftime(ts,'%y/%m/%d %H:%M:%S') || CASE event_type
    WHEN 'error'  THEN ' ERROR Executor: Exception in task ' || CAST(v%7 AS VARCHAR) || '.0 in stage '
         || CAST(v%3 AS VARCHAR) || '.0 (TID ' || CAST(event_id AS VARCHAR)
         || '): java.lang.OutOfMemoryError: Java heap space'
    WHEN 'signup' THEN ' WARN TaskSetManager: Lost executor ' || CAST(user_id%5 AS VARCHAR)
         || ' on worker-1: Container killed'
    WHEN 'view'   THEN ' INFO X: FetchFailed partition ' || CAST(v%4 AS VARCHAR) || ' at 0xab'
    ELSE ' INFO BlockManager: ok' END AS line_text
  FROM b)"""

GC_LINES = BASE + """,
gl AS (
  SELECT path, event_id AS line_no, '[' || CAST(event_id AS VARCHAR) || '.' || lpad(CAST(v%1000 AS VARCHAR),3,'0')
    || 's][info][gc] GC(' || CAST(event_id AS VARCHAR) || ') '
    || CASE event_type WHEN 'error' THEN 'Pause Full (System.gc()) '
         WHEN 'view' THEN 'Concurrent Mark Cycle '
         ELSE 'Pause Young (Normal) (G1 Evacuation Pause) ' END
    || CASE WHEN event_type='view' THEN ''
         ELSE CAST(100+v%400 AS VARCHAR) || 'M->' || CAST(v%200 AS VARCHAR) || 'M(512M) ' END
    || CAST(v%2000 AS VARCHAR) || '.' || lpad(CAST(user_id%1000 AS VARCHAR),3,'0') || 'ms' AS line_text
  FROM b)"""

DOC_LINES = """dl AS (
  SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path, CAST(generate_subscripts(p, 1) AS BIGINT) AS line_no,
         unnest(p) AS line_text
  FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') p FROM documents))"""


# ------------------------------------------------------------ expressions --
def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def first_group(x: str, regexes) -> str:
    return "coalesce(" + ", ".join(
        f"nullif(regexp_extract({x}, {q(rx)}, 1), '')" for rx in regexes) + ")"


def short_ts(x: str) -> str:
    return first_group(x, P.SHORT_TS_PATTERNS)


def full_ts(x: str) -> str:
    return first_group(x, P.FULL_TS_PATTERNS)


def normalize(x: str) -> str:
    for rx, rep in P.NORMALIZE_RULES:
        x = f"regexp_replace({x}, {q(rx)}, {q(rep)}, 'gi')"
    return x


def error_pattern(x: str, strip_prefix: bool) -> str:
    has_level = " OR ".join(f"contains({x}, {q(lv)})" for lv in P.LOG_LEVELS)
    first = f"substr({x}, strpos({x}, ':') + 1)"
    rest = (f"CASE WHEN regexp_matches({x}, {q(P.LEVEL_PREFIX)}) "
            f"THEN regexp_replace({x}, {q(P.LEVEL_PREFIX)}, '') ELSE {first} END"
            if strip_prefix else first)
    return (f"CASE WHEN ({has_level}) AND strpos({x}, ':') > 0 "
            f"THEN {normalize(strip(rest))} ELSE {strip(x)} END")


def class_values() -> str:
    return "(VALUES " + ", ".join(f"({q(n)}, {q(rx)})" for n, rx in P.CLASS_RULES) + ") c(pattern, rx)"


def typed_vars_rows(src: str, key: str = "pattern") -> str:
    """UNION ALL of typed-variable facts (one per type at most)."""
    parts = []
    for i, (rx, kind) in enumerate(P.TYPED_VARIABLE_RULES):
        parts.append(
            f"SELECT {key}, 'var' f, {q(kind + ':')} || regexp_extract(line_text, {q(rx)}, 1, 'i') v, "
            f"path p, line_no l, {i} i FROM {src} WHERE regexp_matches(line_text, {q(rx)}, 'i')")
    return "\n  UNION ALL ".join(parts)


def variables_rows(src: str, key: str = "pattern") -> str:
    """UNION ALL of the strings removed by the rewrites, in rule order."""
    parts = []
    for i, (rx, _) in enumerate(P.NORMALIZE_RULES):
        parts.append(
            f"SELECT {key}, 'var' f, unnest(a) v, path p, line_no l, "
            f"{i}*100000 + generate_subscripts(a, 1) i "
            f"FROM (SELECT *, regexp_extract_all(line_text, {q(rx)}, 0, 'i') a FROM {src})")
    return "\n  UNION ALL ".join(parts)


def first_k_lists(facts: str, spec: dict, key: str = "pattern") -> str:
    """CTEs dd/rk/lists over a facts CTE (key, f, v, p, l, i).

    spec: output name -> (tag, k, 'value'|'arrival'). Gives, per key, the
    first k distinct values (all if k is None) joined by '|' and the exact distinct count.
    """
    by_value = [t for (t, _, o) in spec.values() if o == "value"]
    inlist = ", ".join(q(t) for t in by_value) or "''"
    cols = []
    for name, (tag, k, _) in spec.items():
        first = "" if k is None else f" AND rn<={k}"
        cols.append(f"string_agg(CASE WHEN f={q(tag)}{first} THEN v END, '|' ORDER BY rn) AS {name}")
        cols.append(f"CAST(count(CASE WHEN f={q(tag)} THEN 1 END) AS BIGINT) AS n_{name}")
    return f"""dd AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key}, f, v ORDER BY p, l, i) r0
                 FROM {facts} WHERE v IS NOT NULL AND v <> '') WHERE r0 = 1),
rk AS (
  SELECT *, row_number() OVER (PARTITION BY {key}, f ORDER BY
      CASE WHEN f IN ({inlist}) THEN v END NULLS LAST, p, l, i, v) rn FROM dd),
lists AS (SELECT {key}, {', '.join(cols)} FROM rk GROUP BY {key})"""


# --------------------------------------------------------------------- GC --
_SHAPES = {"A": (P.GC_SHAPE_A, {"ts": 1, "event": 2, "id": 3, "desc": 4, "before": 5,
                                "after": 6, "heap": 7, "dur": 8}),
           "B": (P.GC_SHAPE_B, {"ts": 1, "event": 2, "id": 3, "desc": 4, "dur": 5,
                                "before": 6, "after": 7, "heap": 8}),
           "C": (P.GC_SHAPE_C, {"ts": 1, "event": 2, "id": 3, "desc": 4, "dur": 5})}


def _gc_field(field: str) -> str:
    arms = [f"WHEN shape = '{s}' THEN regexp_extract(l, {q(rx)}, {g[field]})"
            for s, (rx, g) in _SHAPES.items() if field in g]
    return "CASE " + " ".join(arms) + " END"


def size_bytes(x: str) -> str:
    s2 = f"upper(replace({strip(x)}, ',', ''))"
    rx = q(r"^(\d+(?:\.\d+)?)\s*([KMGT])B?$")
    unit = " ".join(f"WHEN '{u}' THEN {float(m)}" for u, m in P.SIZE_UNITS)
    return (f"CASE WHEN regexp_matches({s2}, {rx}) THEN CAST(floor(TRY_CAST(regexp_extract({s2}, {rx}, 1) AS DOUBLE)"
            f" * CASE regexp_extract({s2}, {rx}, 2) {unit} END) AS BIGINT)"
            f" WHEN regexp_matches({s2}, '^\\d+$') THEN TRY_CAST({s2} AS BIGINT) END")


def duration(x: str) -> str:
    s2 = f"lower(replace({strip(x)}, ',', ''))"
    return (f"CASE WHEN suffix({s2}, 'ms') THEN TRY_CAST({strip(f'left({s2}, length({s2}) - 2)')} AS DOUBLE)"
            f" WHEN suffix({s2}, 's') THEN TRY_CAST({strip(f'left({s2}, length({s2}) - 1)')} AS DOUBLE) * 1000.0"
            f" ELSE TRY_CAST({s2} AS DOUBLE) END")


def gc_case(d: str, idx: int, other: str) -> str:
    low = f"lower({d})"
    arms = []
    for kind in P.GC_KINDS:
        cond = " OR ".join(f"contains({low}, {q(sub)})" for sub in kind[4])
        val = kind[idx]
        val = q(val) if isinstance(val, str) else ("true" if val else "false")
        arms.append(f"WHEN {cond} THEN {val}")
    return "CASE " + " ".join(arms) + f" ELSE {other} END"


def fmt(x: str, decimals: int, thousands: bool = False) -> str:
    spec = "{:" + ("," if thousands else "") + f".{decimals}f" + "}"
    return f"format('{spec}', {x})"


def bytes_to_mb(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN {fmt(f'greatest({x}, 0) / 1048576.0', 0)} || 'MB' ELSE '?' END"


def nice_ms(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} < 0 THEN '?' WHEN {x} < 1000 THEN {fmt(x, 3, True)} || 'ms'"
            f" ELSE {fmt(f'{x} / 1000.0', 3, True)} || 's' END")


def pct(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN {fmt(f'{x} * 100.0', 1)} || '%' ELSE '?' END"


def service(path: str) -> str:
    return (f"coalesce(nullif(regexp_extract({path}, 'service=([^/]+)', 1), ''), "
            f"CASE WHEN contains({path}, 'service/executor') THEN 'executor' END)")


def executor(path: str) -> str:
    return (f"coalesce(nullif(regexp_extract({path}, {q(r'executor-(\d+(?:\.\d+)*)')}, 1), ''), "
            f"CASE WHEN contains(lower(coalesce({path}, 'None')), 'driver') THEN 'driver' ELSE 'unknown' END)")


GC_EVENTS = GC_LINES + f""",
gm AS (
  SELECT path, line_no, line_text l, CASE
      WHEN regexp_matches(line_text, {q(P.GC_SHAPE_A)}) THEN 'A'
      WHEN regexp_matches(line_text, {q(P.GC_SHAPE_B)}) THEN 'B'
      WHEN regexp_matches(line_text, {q(P.GC_SHAPE_C)}) THEN 'C' END shape
  FROM gl),
gg AS (
  SELECT path, line_no, {_gc_field('ts')} ts_s, {_gc_field('event')} event, {_gc_field('id')} id_s,
    coalesce({_gc_field('desc')}, '') d0, {_gc_field('before')} bs, {_gc_field('after')} af,
    {_gc_field('heap')} hp, {_gc_field('dur')} du
  FROM gm WHERE shape IS NOT NULL),
g1 AS (
  SELECT path, line_no, event, TRY_CAST(id_s AS BIGINT) event_id, TRY_CAST(ts_s AS DOUBLE) timestamp_s,
    {duration('du')} duration_ms, coalesce(bs, '?') mem_before_str, coalesce(af, '?') mem_after_str,
    coalesce(hp, '?') heap_str, {size_bytes('bs')} mem_before_bytes, {size_bytes('af')} mem_after_bytes,
    {size_bytes('hp')} heap_bytes, {strip('d0')} d
  FROM gg),
gev AS (
  SELECT *, {bytes_to_mb('freed_bytes')} freed_mb_str,
    CASE WHEN freed_bytes >= 0 AND heap_bytes > 0 THEN freed_bytes / heap_bytes END freed_pct
  FROM (SELECT * EXCLUDE (d),
    CASE WHEN mem_before_bytes >= 0 AND mem_after_bytes >= 0 THEN mem_before_bytes - mem_after_bytes END freed_bytes,
    {gc_case('d', 0, "'other'")} kind,
    {gc_case('d', 1, "CASE WHEN substr(d, 1, 32) <> '' THEN substr(d, 1, 32) ELSE 'Other' END")} kind_short,
    {gc_case('d', 2, 'false')} stw, {gc_case('d', 3, 'false')} "full",
    nullif(array_to_string(regexp_extract_all(d, {q(r'\(([^)]+)\)')}, 1), ' | '), '') cause,
    {service('path')} service
  FROM g1))"""


# ------------------------------------------------------------------ cases --
def _case_sql() -> str:
    from ..sources import fixtures as FX
    types = FX.CASE_EVENT_TYPES
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE event_type = {q(t)}) AS BIGINT) n_{t}" for t in types)
    claims = ", ".join(
        f"CASE WHEN n_{t} > 0 THEN (CASE WHEN n_{t} >= 3 THEN '[PROVEN]' ELSE '[INFERRED]' END)"
        f" || ' {t} events: ' || CAST(n_{t} AS VARCHAR) || '.' END" for t in types)
    keys = ", ".join(f"CASE WHEN n_{t} > 0 THEN {q(k)} END" for t, k in FX.CASE_CLAIM_KEYS)
    statuses = "[" + ", ".join(q(s) for s in FX.CASE_STATUSES) + "]"
    actions = "[" + ", ".join(q(s) for s in FX.CASE_ACTIONS) + "]"
    return LOG_LINES + f""",
cl AS (SELECT b.user_id case_id, ll.* FROM ll JOIN b ON ll.line_no = b.event_id),
cev AS (SELECT case_id, c.pattern, CAST(count(*) AS BIGINT) count, min(line_no) first_line
        FROM cl JOIN {class_values()} ON regexp_matches(cl.line_text, c.rx, 'i') GROUP BY ALL),
agg AS (SELECT user_id case_id, {counts}, sum(v) sv,
          arg_min(path, event_id) FILTER (WHERE event_type = 'error') err_path FROM b GROUP BY user_id),
sug AS (SELECT case_id, list(pattern ORDER BY first_line, pattern) suggested FROM cev GROUP BY case_id),
ext AS (SELECT case_id, list(event_type ORDER BY f) existing FROM
          (SELECT user_id case_id, event_type, min(event_id) f FROM b GROUP BY ALL) GROUP BY case_id),
cases AS (
  SELECT agg.case_id, {', '.join('n_' + t for t in types)},
    CAST(n_error % 8 AS INTEGER) iteration, {statuses}[CAST(n_view % 3 AS INTEGER) + 1] last_status,
    CAST(sv % 100 AS DOUBLE) / 100.0 confidence, n_purchase % 2 = 1 critic_approved,
    {actions}[CAST(n_click % 5 AS INTEGER) + 1] proposed_action,
    CAST(n_signup % 8 AS INTEGER) analyze_parse_loops,
    CAST((n_click * 7) % 61 - 30 AS DOUBLE) / 100.0 critic_adjust,
    n_view % 2 = 0 critic_approve,
    CASE WHEN n_error % 3 = 0 THEN '' ELSE 'Evidence is thin.' END critic_reasons,
    coalesce(err_path, '') logs_path,
    concat_ws(' ', {claims}) rca,
    list_filter([{keys}], lambda x: x IS NOT NULL) key_evidence,
    coalesce(suggested, []::VARCHAR[]) suggested, coalesce(existing, []::VARCHAR[]) existing
  FROM agg LEFT JOIN sug USING (case_id) LEFT JOIN ext USING (case_id))"""


CASES = _case_sql()


def dedupe_keep_order(arr: str) -> str:
    t = f"list_filter(list_transform({arr}, lambda x: {strip('x')}), lambda x: x <> '')"
    return (f"list_filter({t}, lambda x, i: NOT list_contains("
            f"list_transform({t}[1:i-1], lambda y: lower(y)), lower(x)))")
