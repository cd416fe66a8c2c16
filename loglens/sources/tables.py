"""Parquet tables of a scale-factor folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


#: Rows that a task gets of a scan with few splits. What is derived from a row and sorted or hashed by the task that reads it
#: (evidence has some six facts of 200 bytes) then stays in some hundred MB, whatever the size of the table.
ROWS_PER_TASK = 125_000


def balanced(df: DataFrame) -> DataFrame:
    """Spread a scan over the cluster when it has fewer splits than cores, or than ``ROWS_PER_TASK`` asks for.

    A small file with one row group is read by one task, and every regex
    after it would run on one core; a compact table of many rows has few splits, and each
    task would hold what comes of millions. Rows are counted from the files' footers.
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()          # planning only, no job
    except Exception:                               # no SparkContext (remote session)
        return df
    tasks = max(cores, -(-df.count() // ROWS_PER_TASK))
    return df.repartition(tasks) if splits < tasks else df


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """One table; Catalyst prunes columns and pushes filters into the scan."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return balanced(df) if spread else df
