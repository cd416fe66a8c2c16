"""Column builders for GC log lines: shape match, sizes, durations, kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import py_strip

# group numbers of each field per shape
_GROUPS = {
    "A": {"ts": 1, "event": 2, "id": 3, "desc": 4, "before": 5, "after": 6, "heap": 7, "dur": 8},
    "B": {"ts": 1, "event": 2, "id": 3, "desc": 4, "dur": 5, "before": 6, "after": 7, "heap": 8},
    "C": {"ts": 1, "event": 2, "id": 3, "desc": 4, "dur": 5},
}
_RX = {"A": P.GC_SHAPE_A, "B": P.GC_SHAPE_B, "C": P.GC_SHAPE_C}


SEP = "\u0001"        # joins the packed groups; never part of a log line


def _packer(shape: str) -> tuple[str, str]:
    """Whole-line regex for one shape and the replacement that packs its
    groups: ``^.*?`` finds the leftmost match exactly like a search, the
    tail swallows the rest, so one evaluation yields every group."""
    body = _RX[shape][len("(?i)"):]
    groups = _GROUPS[shape]
    order = ["ts", "event", "id", "desc", "before", "after", "heap", "dur"]
    rep = SEP.join(f"${groups[f]}" if f in groups else "" for f in order)
    return f"(?is)^.*?(?:{body}).*$", rep


def gc_packed(line: Column) -> dict[str, Column]:
    """Per shape: the line rewritten to its packed groups; equal to the line
    when the shape does not match. Every shape needs ``GC(``, shapes A and B
    also an arrow; a plain ``contains`` rules the other lines out before a
    regex backtracks over them (NULL then)."""
    is_gc = F.lower(line).contains("gc(")
    out = {}
    for shape in ("A", "B", "C"):
        rx, rep = _packer(shape)
        packed = F.regexp_replace(line, rx, rep)
        out[shape] = F.when(is_gc & line.contains("->") if shape in ("A", "B") else is_gc, packed)
    return out


def gc_shape(line: Column) -> Column:
    """'A', 'B' or 'C': the first GC line shape that matches, else NULL."""
    return (F.when(line.rlike(P.GC_SHAPE_A), F.lit("A"))
            .when(line.rlike(P.GC_SHAPE_B), F.lit("B"))
            .when(line.rlike(P.GC_SHAPE_C), F.lit("C")))


GC_FIELDS = ["ts", "event", "id", "desc", "before", "after", "heap", "dur"]


SIZE_RX = r"^(\d+(?:\.\d+)?)\s*([KMGT])B?$"


def size_norm(s: Column) -> Column:
    """Stripped, upper-cased, commas removed (what the size rules see)."""
    return F.upper(F.replace(py_strip(s), F.lit(","), F.lit("")))


def size_from_norm(s2: Column) -> Column:
    """Bytes of a normalised size: ``N[.M]`` K/M/G/T[B] (binary, truncated),
    bare digits are bytes, else NULL."""
    num = F.regexp_extract(s2, SIZE_RX, 1)
    unit = F.regexp_extract(s2, SIZE_RX, 2)
    mult = reduce(lambda acc, u: acc.when(unit == u[0], F.lit(float(u[1]))),
                  P.SIZE_UNITS[1:],
                  F.when(unit == P.SIZE_UNITS[0][0], F.lit(float(P.SIZE_UNITS[0][1]))))
    scaled = F.floor(num.try_cast("double") * mult).cast("bigint")
    return (F.when(num != "", scaled)
            .when(s2.rlike(r"^\d+$"), s2.try_cast("bigint")))


def size_to_bytes(s: Column) -> Column:
    """``1,024M`` -> 1073741824 (binary units, K/M/G/T[B], truncated),
    bare digits are bytes, anything else NULL."""
    return size_from_norm(size_norm(s))


def duration_ms(s: Column) -> Column:
    """``3.4ms`` -> 3.4, ``1.5s`` -> 1500.0, bare numbers are ms; NULL when
    the number does not parse (``1.2.3ms``)."""
    s2 = F.lower(F.replace(py_strip(s), F.lit(","), F.lit("")))
    n = F.length(s2)
    return (F.when(s2.endswith("ms"),
                   py_strip(F.substring(s2, F.lit(1), n - 2)).try_cast("double"))
            .when(s2.endswith("s"),
                  py_strip(F.substring(s2, F.lit(1), n - 1)).try_cast("double") * 1000.0)
            .otherwise(s2.try_cast("double")))


def gc_kind_of(low: Column) -> Column:
    """kind of a lower-cased GC description (first rule that matches)."""
    out = None
    for kind in P.GC_KINDS:
        cond = reduce(lambda a, b: a | b, [low.contains(sub) for sub in kind[4]])
        out = F.when(cond, F.lit(kind[0])) if out is None else out.when(cond, F.lit(kind[0]))
    return out.otherwise(F.lit("other"))


def gc_kind_attrs(kind: Column, desc: Column) -> dict[str, Column]:
    """kind_short, stw, full, cause from the kind and the stripped text."""
    def by_kind(idx: int, other):
        out = None
        for k in P.GC_KINDS:
            out = F.when(kind == k[0], F.lit(k[idx])) if out is None else \
                out.when(kind == k[0], F.lit(k[idx]))
        return out.otherwise(other)
    short_other = F.when(F.substring(desc, 1, 32) != "", F.substring(desc, 1, 32)).otherwise("Other")
    cause = F.nullif(F.array_join(F.regexp_extract_all(desc, F.lit(r"\(([^)]+)\)"), 1), " | "),
                     F.lit(""))
    return {"kind_short": by_kind(1, short_other), "stw": by_kind(2, F.lit(False)),
            "full": by_kind(3, F.lit(False)), "cause": cause}


def gc_kind(desc: Column, low: Column | None = None) -> dict[str, Column]:
    """kind, kind_short, stw, full, cause of a stripped GC description."""
    kind = gc_kind_of(F.lower(desc) if low is None else low)
    return {"kind": kind, **gc_kind_attrs(kind, desc)}


def service_from_path(path: Column) -> Column:
    """``service=<name>`` directory, else ``executor`` for ``service/executor``."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"service=([^/]+)", 1), F.lit("")),
                      F.when(path.contains("service/executor"), F.lit("executor")))


def executor_from_path(path: Column, compat: bool = False) -> Column:
    """IP of ``executor-<ip>`` in the path; else ``driver`` / ``unknown``.

    ``compat=True`` keeps the original greedy ``[\\d.]+`` that also takes a
    trailing dot (``executor-10.0.0.1.log`` -> ``10.0.0.1.``).
    """
    rx = r"executor-([\d\.]+)" if compat else r"executor-(\d+(?:\.\d+)*)"
    ip = F.nullif(F.regexp_extract(path, rx, 1), F.lit(""))
    fallback = F.when(F.lower(F.coalesce(path, F.lit("None"))).contains("driver"),
                      F.lit("driver")).otherwise(F.lit("unknown"))
    return F.coalesce(ip, fallback)


def fmt_fixed(x: Column, decimals: int, thousands: bool = False) -> Column:
    """Python ``f"{x:.Nf}"`` (round half to even), ``thousands`` adds commas."""
    s = F.format_number(x, decimals)
    return s if thousands else F.replace(s, F.lit(","), F.lit(""))


def py_format(template: str, x: Column) -> Column:
    """A one-placeholder Python format such as ``"Long pause ({:.2f}s)"``."""
    import re
    m = re.fullmatch(r"(.*)\{:\.(\d)f\}(.*)", template, flags=re.S)
    return F.concat(F.lit(m.group(1)), fmt_fixed(x, int(m.group(2))), F.lit(m.group(3)))


def bytes_to_mb(n: Column) -> Column:
    """``123MB`` or ``?`` for missing."""
    return F.when(n >= 0, F.concat(fmt_fixed(F.greatest(n, F.lit(0)) / 1048576.0, 0),
                                   F.lit("MB"))).otherwise(F.lit("?"))


def pct(x: Column) -> Column:
    return F.when(x >= 0, F.concat(fmt_fixed(x * 100.0, 1), F.lit("%"))).otherwise(F.lit("?"))


def nice_ms(ms: Column) -> Column:
    """``1,234.567ms`` below a second, else ``1.235s``; ``?`` for missing."""
    return (F.when(ms.isNull() | (ms < 0), F.lit("?"))
            .when(ms < 1000, F.concat(fmt_fixed(ms, 3, True), F.lit("ms")))
            .otherwise(F.concat(fmt_fixed(ms / 1000.0, 3, True), F.lit("s"))))
