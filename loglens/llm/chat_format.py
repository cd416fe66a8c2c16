"""Chat formatting: logged snapshots of one growing conversation collapse to the longest.

Turns are numbered by (turn, role, text) within a conversation. A turn's prefix hash is the
running exclusive-or of two 64-bit hashes of (number, role, text) of all turns so far: a rolling
hash that a window computes as a running aggregate. Conversations with equal (length, last
prefix hash) are one class, kept as its smallest id. An anti-join drops every class whose
(length, hash) is also an inner prefix of a longer one. What stays is rendered.

Both sides of the anti-join are distinct (length, hash) rows after partial aggregation, so a
first turn or a conversation that a third of all rows share is a few rows for each task. A
conversation's turns meet in one task only for its own window and its own text, one result row.

Defined cases: rows whose conv_id or turn is null belong to no conversation and are left out. A
null role or text is the empty string, both for comparison and rendering. Turns need not start
at 0 or follow on; only their order counts. Rows repeated in all four columns count once; turns
that repeat a number with other contents follow each other by role and text. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How a turn is written; ``{role}`` and ``{text}`` are replaced.
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, k, role, text, h1, h2, n): turns numbered from 1, their prefix hashes, and the number of turns."""
    turns = (rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
             .select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text")))
    every = Window.partitionBy("conv_id")
    by_turn = every.orderBy("turn", "role", "text")
    same = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "turn", "role", "text").orderBy("turn")))
    turns = turns.filter("again = 1").drop("again")
    turns = turns.withColumn("k", F.row_number().over(by_turn))
    one, two = F.xxhash64("k", "role", "text"), F.xxhash64(F.lit("second"), "text", "role", "k")
    so_far = same.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.select("conv_id", "k", "role", "text", F.bit_xor(one).over(so_far).alias("h1"),
                        F.bit_xor(two).over(so_far).alias("h2"), F.count("*").over(every).alias("n"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n, n_copies): conversations that prefix no longer one; of equal ones the smallest id."""
    whole = (turns.filter("k = n").groupBy("n", "h1", "h2")
             .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")))
    inner = turns.filter("k < n").select(F.col("k").cast("bigint").alias("n"), "h1", "h2").distinct()
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", "n", "n_copies")


def rendered(turns: DataFrame, chosen: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) of the chosen conversations."""
    head, rest = template.split("{role}")
    middle, tail = rest.split("{text}")
    said = F.concat(F.lit(head), F.col("role"), F.lit(middle), F.col("text"), F.lit(tail))
    body = turns.select("conv_id", F.struct("k", said.alias("said")).alias("turn")).join(chosen, "conv_id")
    return (body.groupBy("conv_id").agg(F.first("n").alias("n_turns"), F.first("n_copies").alias("n_copies"),
                                        F.sort_array(F.collect_list("turn")).alias("turns"))
            .select("conv_id", "n_turns", "n_copies", F.concat_ws("", F.col("turns.said")).alias("text")))


def collapsed(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    turns = ordered_turns(rows)
    return rendered(turns, maximal(turns), template)
