"""Order-dependent columns over a *global* order without a single-task window.

``Window.orderBy(...)`` with no partition key runs in one task. Here the rows
are range-partitioned on the full (unique) sort key instead, so every
partition holds one contiguous, balanced slice of the order; the window runs
per slice, and the slice boundaries are patched from a small carry table
(one row per slice, or per slice and group) that is joined back.

The slice id is taken right after the range shuffle and the result is
checkpointed to the session's checkpoint folder, so a retried task can never
see a different slice assignment (and lineage is cut).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def slice_by_order(df: DataFrame, order: list[Column], n: int | None = None) -> DataFrame:
    """Add ``_k0.._kN`` sort-key columns and ``_slice`` (range partition id)."""
    spark = df.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select("*", *[c.alias(f"_k{i}") for i, c in enumerate(order)])
    keys = [f"_k{i}" for i in range(len(order))]
    checkpoint_dir(spark)
    return (keyed.repartitionByRange(n, *keys)
            .withColumn("_slice", F.spark_partition_id())
            .checkpoint(eager=True))


def _keys(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c.startswith("_k") and c[2:].isdigit()),
                  key=lambda c: int(c[2:]))


def lag_in_order(sliced: DataFrame, value: str, out: str,
                 group: str | None = None) -> DataFrame:
    """``out`` = previous ``value`` in the global order (within ``group``).

    Equivalent to ``lag(value) over (partition by group order by keys)``.
    """
    keys = _keys(sliced)
    part = ["_slice"] + ([group] if group else [])
    w = Window.partitionBy(*part).orderBy(*keys)
    x = sliced.withColumn("_prev", F.lag(value).over(w))
    # last value per slice (and group): one row per slice and group
    last = (x.groupBy(*part)
            .agg(F.max_by(F.col(value), F.struct(*keys)).alias("_last")))
    # previous non-empty slice's last value (per group): window over the
    # carry table only, which has at most (#slices x #groups) rows
    wc = Window.partitionBy(*([group] if group else [])).orderBy("_slice")
    carry = last.select(*part, F.lag("_last").over(wc).alias("_carry"))
    return (x.join(carry, part, "left")
            .withColumn(out, F.coalesce(F.col("_prev"), F.col("_carry")))
            .drop("_prev", "_carry"))


def index_in_order(sliced: DataFrame, out: str = "pos") -> DataFrame:
    """``out`` = 1-based position in the global order (row_number)."""
    keys = _keys(sliced)
    w = Window.partitionBy("_slice").orderBy(*keys)
    x = sliced.withColumn("_rn", F.row_number().over(w))
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    wc = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("_slice", F.coalesce(F.sum("_n").over(wc), F.lit(0)).alias("_off"))
    return (x.join(offs, "_slice", "left")
            .withColumn(out, (F.col("_off") + F.col("_rn")).cast("bigint"))
            .drop("_rn", "_off"))


def drop_order_cols(df: DataFrame) -> DataFrame:
    return df.drop("_slice", *_keys(df))


def rank_percentiles(df: DataFrame, value: str, ps: list[float],
                     slices: int | None = None) -> DataFrame:
    """Exact percentiles, linear between closest ranks, without any task
    holding all values: equal values are counted first (map-side, so a value
    on a third of the rows is one row after it), the distinct values get
    their running count through range slices, and only the (at most 2 per p)
    values that hold a needed rank survive.

    One row with ``p<i>`` columns (NULL when there is no value).
    """
    counts = (df.select(F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
              .groupBy("_x").agg(F.count(F.lit(1)).alias("_n")))
    sliced = slice_by_order(counts, [F.col("_x")], slices)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sliced.groupBy("_slice").agg(F.sum("_n").alias("_size"))       # one row per slice
               .select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off")))
    so_far = (Window.partitionBy("_slice").orderBy("_x")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (sliced.withColumn("_cum", F.sum("_n").over(so_far)).join(offsets, "_slice")
              .select("_x", "_n", (F.col("_off") + F.col("_cum")).alias("_last")))
    # the two ranks of every p with their weights, from the total
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in ps]
    ranks = F.array(*[
        F.struct(F.lit(i).alias("i"), (F.floor(k) + up + 1).cast("bigint").alias("rank"),
                 (k - F.floor(k) if up else 1 - (k - F.floor(k))).alias("weight"))
        for i, k in enumerate(at) for up in (0, 1)])
    needed = sliced.agg(F.sum("_n").alias("n")).select(ranks.alias("r")).scalar()
    held = ranked.withColumn("_needed", needed).withColumn("_r", F.filter(
        "_needed", lambda r: (r["weight"] > 0) & (r["rank"] <= F.col("_last"))
        & (r["rank"] > F.col("_last") - F.col("_n"))))
    parts = held.select("_x", F.explode("_r").alias("_r"))
    return parts.agg(*[F.sum(F.when(F.col("_r.i") == i, F.col("_x") * F.col("_r.weight"))).alias(f"p{i}")
                       for i in range(len(ps))])
