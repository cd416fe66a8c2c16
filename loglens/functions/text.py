"""Column builders for log text: timestamps, templates, variables, classes.

All of them are plain Catalyst expressions (regexp_extract, regexp_replace,
rlike, higher-order array functions), so they run inside whole-stage codegen
and never leave the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

# Characters used to mark regex hits when computing spans; a line that
# already contains them would confuse the span arithmetic.
MARK_OPEN = "\u0001"
MARK_CLOSE = "\u0002"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# FIXED VALUES: the characters Python's str.isspace() accepts
PY_WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(col) -> Column:
    """Strip leading/trailing whitespace like Python's ``str.strip``.

    Spark's ``trim`` removes only spaces; ``btrim`` with Python's whitespace
    set does the same as ``str.strip`` without a regex.
    """
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def first_group(col, regexes) -> Column:
    """First non-empty group 1 among ``regexes`` (first hit wins), else NULL."""
    c = _c(col)
    return F.coalesce(*[F.nullif(F.regexp_extract(c, rx, 1), F.lit(""))
                        for rx in regexes])


def extract_short_ts(col) -> Column:
    """Timestamp of the class-keyed evidence map (ISO, HH:MM:SS, N.Ns)."""
    return first_group(col, P.SHORT_TS_PATTERNS)


def extract_timestamp(col) -> Column:
    """Timestamp of the template-keyed evidence map (three shapes)."""
    return first_group(col, P.FULL_TS_PATTERNS)


def event_time(col) -> Column:
    """``extract_timestamp`` as a TIMESTAMP: two- or four-digit years with ``/``
    or ``-``, bracketed ISO times, epoch seconds. NULL if none can be read."""
    ts = extract_timestamp(col)
    day = F.translate(F.regexp_replace(ts, r"\s+", " "), "/", "-")
    epoch = ts.try_cast("double")
    return (F.when(ts.contains("T"), F.coalesce(F.try_to_timestamp(ts),
                                                F.try_to_timestamp(F.substring(ts, 1, 19))))
            .when(epoch.between(0, 1e11), F.timestamp_seconds(epoch))
            .when(F.length(day) == 17, F.try_to_timestamp(day, F.lit("yy-MM-dd HH:mm:ss")))
            .when(F.length(day) == 19, F.try_to_timestamp(day, F.lit("yyyy-MM-dd HH:mm:ss"))))


def normalize_pattern(col) -> Column:
    """Apply the seven case-insensitive rewrites in order (log templating)."""
    return reduce(lambda acc, rule: F.regexp_replace(acc, "(?i)" + rule[0], rule[1]),
                  P.NORMALIZE_RULES, _c(col))


def extract_variables(col) -> Column:
    """Strings the rewrites remove, in rule order, as ARRAY<STRING>."""
    c = _c(col)
    return F.concat(*[F.regexp_extract_all(c, F.lit("(?i)" + rx), 0)
                      for rx, _ in P.NORMALIZE_RULES])


def has_level(col) -> Column:
    c = _c(col)
    return reduce(lambda a, b: a | b, [c.contains(lv) for lv in P.LOG_LEVELS])


def error_pattern(col, strip_prefix: bool = True) -> Column:
    """Template key of a log line.

    A line that names a log level and holds a ``:`` is keyed on the
    normalised message. ``strip_prefix=False`` reproduces the original
    behaviour of cutting at the *first* colon (inside ``HH:MM:SS``);
    ``strip_prefix=True`` removes ``timestamp LEVEL logger:`` as documented.
    Other lines are keyed on the stripped line, not normalised.
    """
    c = _c(col)
    rest_first = F.substring(c, F.instr(c, ":") + 1, F.lit(1 << 30))
    if strip_prefix:
        # one regex evaluation: an unchanged line means the prefix is absent
        rest = F.coalesce(F.nullif(F.regexp_replace(c, P.LEVEL_PREFIX, ""), c), rest_first)
    else:
        rest = rest_first
    leveled = has_level(c) & (F.instr(c, ":") > 0)
    return F.when(leveled, normalize_pattern(py_strip(rest))).otherwise(py_strip(c))


def typed_variables(col) -> Column:
    """``executor_id:N``, ``task_id:N``, ``stage_id:N``, ``ip_address:a.b.c.d``:
    the first match per type, as ARRAY<STRING> in type order."""
    c = _c(col)
    items = []
    for rx, kind in P.TYPED_VARIABLE_RULES:
        # nullif keeps it to one regex evaluation (no match -> bare prefix -> NULL)
        tagged = F.concat(F.lit(kind + ":"), F.regexp_extract(c, "(?i)" + rx, 1))
        items.append(F.nullif(tagged, F.lit(kind + ":")))
    return F.array_compact(F.array(*items))


def class_labels(col) -> Column:
    """Error classes a line belongs to (multi-label), ARRAY<STRING>."""
    c = _c(col)
    return F.array_compact(F.array(*[F.when(c.rlike("(?i)" + rx), F.lit(name))
                                     for name, rx in P.CLASS_RULES]))


def content_key(col) -> Column:
    """First 12 hex digits of the MD5 of the text."""
    return F.substring(F.md5(_c(col)), 1, 12)


def truncate(col, n: int, always_ellipsis: bool = False) -> Column:
    """``text[:n] + '...'``; only when longer unless ``always_ellipsis``."""
    c = _c(col)
    cut = F.concat(F.substring(c, 1, n), F.lit("..."))
    return cut if always_ellipsis else F.when(F.length(c) > n, cut).otherwise(c)


def list_display(arr, k: int) -> Column:
    """``a, b, c ... (+m more)`` for the first ``k`` items of an array."""
    a = _c(arr)
    head = F.array_join(F.slice(a, 1, k), ", ")
    more = F.concat(F.lit(" ... (+"), (F.size(a) - k).cast("string"), F.lit(" more)"))
    return F.when(F.size(a) > k, F.concat(head, more)).otherwise(head)


def dedupe_keep_order(arr) -> Column:
    """Trim, drop empties, drop case-insensitive repeats, keep first spelling."""
    a = F.filter(F.transform(_c(arr), lambda x: py_strip(x)), lambda x: x != "")
    return F.aggregate(
        a, F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc)
        .otherwise(F.concat(acc, F.array(x))))


def tolerant_json(col) -> Column:
    """Parse JSON from free text: whole string, else first '{' .. last '}'.

    Returns VARIANT; NULL when neither parses.
    """
    c = _c(col)
    start = F.instr(c, "{")
    end = F.length(c) - F.instr(F.reverse(c), "}") + 1
    inner = F.when((start > 0) & (F.instr(c, "}") > 0) & (end > start),
                   F.substring(c, start, end - start + 1))
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(inner))


def match_spans(line, regex: str) -> Column:
    """Code-point spans ``[start, end)`` of all non-overlapping hits of
    ``regex`` in ``line``, left to right, as ARRAY<STRUCT<start INT, end INT>>.

    Mark-and-split: every hit is wrapped in two control characters, the
    marked line is split, and a fold over the pieces adds up the lengths.
    """
    c = _c(line)
    marked = F.regexp_replace(c, regex, MARK_OPEN + "$0" + MARK_CLOSE)
    parts = F.split(marked, MARK_OPEN)
    pieces = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    init = F.struct(F.length(F.element_at(parts, 1)).alias("pos"),
                    F.array().cast("array<struct<start:int,end:int>>").alias("acc"))

    def step(st, p):
        hit_len = F.length(F.substring_index(p, MARK_CLOSE, 1))
        span = F.struct(st["pos"].alias("start"), (st["pos"] + hit_len).alias("end"))
        return F.struct((st["pos"] + F.length(p) - 1).alias("pos"),
                        F.concat(st["acc"], F.array(span)).alias("acc"))

    return F.aggregate(pieces, init, step, lambda st: st["acc"])


def spans_text(spans) -> Column:
    """``start-end|start-end`` rendering of a span array (engine-neutral)."""
    return F.array_join(F.transform(_c(spans), lambda s: F.concat(
        s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), "|")
