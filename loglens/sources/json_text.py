"""Hit rows from JSON arrays and raw text blobs, user context from chats.

All parsing is Catalyst JSON / string expressions on one row at a time
(``from_json``, ``split``, ``posexplode``): no shuffle, no driver work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip

HIT_SCHEMA = "array<struct<line_text:string,path:string,line_no:bigint>>"
HIT_STRUCT = "struct<line_text:string,path:string,line_no:bigint>"


def parse_hit_array(text: Column) -> Column:
    """JSON array -> ARRAY<hit struct>; items that are not objects are
    skipped (the whole array is NULL only when it is not an array)."""
    items = F.from_json(text, "array<string>")
    objects = F.filter(items, lambda e: F.ltrim(e).startswith("{"))
    return F.transform(objects, lambda e: F.from_json(e, HIT_STRUCT))

# Python's str.splitlines() boundaries (also CR LF as one)
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def hits_from_json(df: DataFrame, col: str, keep: list[str] | None = None) -> DataFrame:
    """JSON array of ``{line_text, path, line_no}`` objects -> one row each.

    Rows whose text is not a JSON array give nothing; missing fields are
    NULL and ``line_text`` defaults to ``''``.
    """
    keep = keep or []
    arr = parse_hit_array(F.col(col))
    return (df.select(*keep, F.posexplode(arr).alias("item_no", "h"))
            .select(*keep, "item_no", F.col("h.path").alias("path"),
                    F.col("h.line_no").alias("line_no"),
                    F.coalesce(F.col("h.line_text"), F.lit("")).alias("line_text")))


def extract_json_array(text: Column) -> Column:
    """The JSON array of hits embedded in tool chatter, parsed; NULL when
    the text names no ``line_text`` or nothing parses.

    Takes first ``[`` .. last ``]``, strips one pair of matching quotes,
    tries to parse, then retries with ``\\"`` and ``\\'`` unescaped.
    """
    i = F.instr(text, "[")
    j_rev = F.instr(F.reverse(text), "]")
    j = F.length(text) - j_rev + 1
    blob = py_strip(F.substring(text, i, j - i + 1))
    quoted = ((blob.startswith("'") & blob.endswith("'")) |
              (blob.startswith('"') & blob.endswith('"'))) & (F.length(blob) >= 2)
    body = F.when(quoted, F.substring(blob, F.lit(2), F.length(blob) - 2)).otherwise(blob)
    unescaped = F.replace(F.replace(body, F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'"))
    ok = ((text.contains('"line_text"') | text.contains("'line_text'"))
          & (i > 0) & (j_rev > 0) & (j > i))
    return F.when(ok, F.coalesce(parse_hit_array(body), parse_hit_array(unescaped)))


def hits_from_blob(df: DataFrame, col: str, keep: list[str] | None = None) -> DataFrame:
    """Rows of tool chatter -> hit rows (via :func:`extract_json_array`)."""
    keep = keep or []
    return (df.select(*keep, F.posexplode(extract_json_array(F.col(col))).alias("item_no", "h"))
            .select(*keep, "item_no", F.col("h.path").alias("path"),
                    F.col("h.line_no").alias("line_no"),
                    F.coalesce(F.col("h.line_text"), F.lit("")).alias("line_text")))


def split_lines(text: Column) -> Column:
    """``str.splitlines()``: no trailing empty line, empty text -> []."""
    parts = F.split(text, LINE_BREAKS)
    n = F.size(parts)
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(trimmed)


def lines_from_blob(df: DataFrame, col: str, keep: list[str] | None = None) -> DataFrame:
    """Raw text, one event per line: line_no from 1, path NULL."""
    keep = keep or []
    return (df.select(*keep, F.posexplode(split_lines(F.col(col))).alias("pos", "line_text"))
            .select(*keep, F.lit(None).cast("string").alias("path"),
                    (F.col("pos") + 1).cast("bigint").alias("line_no"), "line_text"))


def user_context(conversations: DataFrame) -> DataFrame:
    """Per conversation: the non-empty user turns in turn order joined by a
    blank line (``''`` when there is none). One group per conversation."""
    turn = F.when((F.col("role") == "user") & (F.col("text") != ""),
                  F.struct("turn", "text"))
    return (conversations.groupBy("conv_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)),
                                          lambda s: s["text"]), "\n\n").alias("user_context")))
