"""Markdown line typing and inline formatting (report text preparation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import slice_by_order
from .text import py_strip

# FIXED VALUES: inline formatting rewrites, in order (after XML escaping).
INLINE_RULES = [
    (r"\*\*(.*?)\*\*", "<b>{0}</b>"),
    (r"\*(.*?)\*", "<i>{0}</i>"),
    (r"`(.*?)`", '<font face="Courier" color="#E74C3C">{0}</font>'),
]
XML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]


def xml_escape(c: Column) -> Column:
    for a, b in XML_ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def inline(c: Column) -> Column:
    """Escape XML, then bold, italic and code spans to tags."""
    out = xml_escape(c)
    for rx, tmpl in INLINE_RULES:
        out = F.regexp_replace(out, rx, tmpl.format("$1"))
    return out


def blocks(lines: DataFrame, doc_col: str = "doc_id", slices: int | None = None) -> DataFrame:
    """Type each line: fence, code, h1-h3, list_item, paragraph, blank.

    Code state toggles at every fence line; consecutive list items share a ``list_id`` (gaps and
    islands: paragraphs and blank lines end a list; it is the number of such ends so far). ``text``
    is the rendered content (headers raw, list items and paragraphs inline-formatted).

    A document of any size is spread over range slices of (document, line number). A slice works its lines out from
    its own start; what came before is an associative state, the parity of the fences and the list
    ends under either parity, which is summed for the documents that lie across an edge: no more rows
    than there are slices and edges.
    """
    line = F.col("line_text")
    s = py_strip(line)
    fence = s.startswith("```")
    sliced = slice_by_order(lines.withColumn("_doc", F.col(doc_col)).withColumn("_fence", fence), [F.col(doc_col), F.col("line_no")], slices)
    own = Window.partitionBy("_slice", "_doc").orderBy("line_no")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    # What a line is outside code; whether it is in code depends on the fences before it.
    plain = (F.when(line.startswith("# "), F.lit("h1")).when(line.startswith("## "), F.lit("h2")).when(line.startswith("### "), F.lit("h3"))
             .when(s.startswith("- ") | s.startswith("* "), F.lit("list_item")).when(s != "", F.lit("paragraph")).otherwise(F.lit("blank")))
    x = sliced.withColumns({"_plain": plain, "_odd": F.coalesce(F.sum(F.col("_fence").cast("int")).over(before), F.lit(0)) % 2 == 1})
    ends = F.col("_plain").isin("paragraph", "blank") & ~F.col("_fence")
    x = x.withColumns({"_ends0": (ends & ~F.col("_odd")).cast("int"), "_ends1": (ends & F.col("_odd")).cast("int")})
    x = x.withColumns({f"_so_far{q}": F.sum(f"_ends{q}").over(own.rowsBetween(Window.unboundedPreceding, 0)) for q in (0, 1)})

    # Only a slice's first and last document can lie across an edge.
    edge = sliced.groupBy("_slice").agg(F.min("_doc").alias("a"), F.max("_doc").alias("b"))
    across = (edge.select("_slice", F.explode(F.array("a", "b")).alias("_doc")).distinct().groupBy("_doc").agg(F.count("*").alias("k"))
              .where("k > 1").select("_doc"))
    state = (x.join(F.broadcast(across), "_doc").groupBy("_doc", "_slice")
             .agg(F.sum(F.col("_fence").cast("int")).alias("f"), F.sum("_ends0").alias("e0"), F.sum("_ends1").alias("e1")))
    earlier = Window.partitionBy("_doc").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    state = state.withColumn("_start", F.coalesce(F.sum("f").over(earlier), F.lit(0)) % 2 == 1)
    state = state.withColumn("_held", F.coalesce(F.sum(F.when(F.col("_start"), F.col("e1")).otherwise(F.col("e0"))).over(earlier), F.lit(0)))
    carry = state.select("_doc", "_slice", "_start", "_held")

    x = x.join(F.broadcast(carry), ["_doc", "_slice"], "left")
    start = F.coalesce("_start", F.lit(False))
    kind = F.when(F.col("_fence"), F.lit("fence")).when(F.col("_odd") != start, F.lit("code")).otherwise(F.col("_plain"))
    text = (F.when(kind == "h1", F.substring(line, 3, 1 << 30))
            .when(kind == "h2", F.substring(line, 4, 1 << 30))
            .when(kind == "h3", F.substring(line, 5, 1 << 30))
            .when(kind == "list_item", inline(F.substring(s, 3, 1 << 30)))
            .when(kind == "paragraph", inline(line))
            .when(kind == "code", line))
    number = F.coalesce("_held", F.lit(0)) + F.when(start, F.col("_so_far1")).otherwise(F.col("_so_far0"))
    return x.select(*lines.columns, kind.alias("block_type"), text.alias("text"), F.when(kind == "list_item", number).alias("list_id"))
