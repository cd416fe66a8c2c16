"""Connected components of a table of edges, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Each round a node takes the smallest label around it, and then that label's own label
    (so labels travel further each round). Rounds end when no label changes; each is written
    to the shared folder, so neither lineage nor plan grows.
    """
    # Both directions come from one pass: a union would work ``edges`` out twice, and a spanning
    # forest need not be the same one the second time.
    sym = stored(edges.filter("a <> b").select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
                 .distinct())
    labels = stored(sym.groupBy("a").agg(F.min("b").alias("b"))
                    .select(F.col("a").alias("node"), F.least("a", "b").alias("component")))
    if labels.isEmpty():
        return labels
    while True:
        around = (sym.join(labels, sym.b == labels.node).groupBy("a").agg(F.min("component").alias("near")))
        taken = (labels.join(around, labels.node == around.a)
                 .select("node", F.col("component").alias("was"), F.least("component", "near").alias("took")))
        of = labels.select(F.col("node").alias("hop"), F.col("component").alias("hop_to"))
        labels2 = stored(taken.join(of, F.col("took") == F.col("hop"))
                         .select("node", "was", F.least("took", "hop_to").alias("component")))
        if labels2.filter("was <> component").isEmpty():
            return labels2.select("node", "component")
        labels = labels2.select("node", "component")
