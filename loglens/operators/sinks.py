"""Sinks: JSON documents and timestamped report tables.

Everything is written by executors straight to storage; nothing passes
through the driver. The timestamped sink appends a new ``run_ts=...``
partition per run, so earlier reports are never overwritten.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def _target(df: DataFrame, base: str | None, name: str) -> str:
    return base or os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")


def sink_json(df: DataFrame, base: str | None = None) -> str:
    """One JSON object per row (JSON lines), written by the executors."""
    path = _target(df, base, "json")
    df.write.mode("errorifexists").json(path)
    return path


def sink_report_tables(df: DataFrame, base: str | None = None, run_ts: str | None = None) -> str:
    """Append the table under ``run_ts=<yyyyMMdd_HHmmss>`` (a new folder per
    run, like the timestamped report files)."""
    path = _target(df, base, "reports")
    ts = F.lit(run_ts) if run_ts else F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
    df.withColumn("run_ts", ts).write.partitionBy("run_ts").mode("append").parquet(path)
    return path


def tool_payload(ev_by_class: DataFrame) -> DataFrame:
    """The combined search payload as one JSON document: total matches,
    patterns found and the evidence map keyed by class. The class-keyed map
    has at most nine rows, so the document has a fixed size bound."""
    entry = F.struct("count", "timestamps", "files", "sample_lines", "variables")
    doc = F.struct(
        F.sum("count").cast("bigint").alias("total_matches"),
        F.array_sort(F.collect_list("pattern")).alias("patterns_found"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("pattern", entry))))
        .alias("evidence_map"))
    return ev_by_class.agg(F.to_json(doc).alias("payload"))
