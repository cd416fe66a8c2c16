"""Run metrics: a long table of (run, agent, scenario, metric, value), checked against expectations and summed up.

A run row says who ran what, when it began and ended, how many steps it took and whether it succeeded; its
evidence is a keyed table. ``run_metrics`` turns both into metric rows, the shape in which runs of
any kind are kept; ``check_runs`` turns the metrics of a run into columns again and applies the
scenario's expectations; ``summarise`` gives each agent's passed runs and averages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["run_id", "agent", "scenario"]
METRICS = ["latency_ms", "success", "transitions", "evidence_patterns", "evidence_occurrences", "has_error_in_result", "has_summary"]
#: What a scenario may expect, and the metric that has to be over 0 for it.
EXPECTATIONS = {"has_evidence_map": "evidence_patterns", "has_error": "has_error_in_result", "has_summary": "has_summary"}


def run_metrics(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, agent, scenario, metric, value).

    ``runs``: the keys, ``started_at``, ``ended_at``, ``transitions``, ``success`` and ``summary``;
    ``evidence``: (run_id, pattern, count). A result has an error if a key of its evidence holds the word
    in any case. A run that has not ended has no latency row.
    """
    of_run = evidence.groupBy("run_id").agg(
        F.count("*").alias("patterns"), F.sum("count").alias("occurrences"), F.max(F.lower("pattern").contains("error")).alias("error"))
    took = F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    wide = runs.join(of_run, "run_id", "left").select(
        *KEYS, (took / 1000.0).alias("latency_ms"), F.col("success").cast("double").alias("success"),
        F.col("transitions").cast("double").alias("transitions"),
        F.coalesce("patterns", F.lit(0)).cast("double").alias("evidence_patterns"),
        F.coalesce("occurrences", F.lit(0)).cast("double").alias("evidence_occurrences"),
        F.coalesce("error", F.lit(False)).cast("double").alias("has_error_in_result"),
        (F.coalesce(F.length("summary"), F.lit(0)) > 0).cast("double").alias("has_summary"))
    return wide.unpivot(KEYS, METRICS, "metric", "value").where("value IS NOT NULL")


def check_runs(metrics: DataFrame, expectations: DataFrame) -> DataFrame:
    """(run_id, agent, scenario, evidence_patterns, evidence_occurrences, has_error, passed) of every run.

    ``expectations``: (scenario, expected) rows, ``expected`` one of ``EXPECTATIONS``. A run passes if each
    thing that its scenario expects is there; a scenario that expects nothing always passes.
    """
    wide = metrics.groupBy(*KEYS).pivot("metric", METRICS).agg(F.max("value"))
    wanted = expectations.groupBy("scenario").agg(*(F.max(F.col("expected") == e).alias(f"wants_{e}") for e in EXPECTATIONS))
    got = wide.join(wanted, "scenario", "left")
    passed = F.lit(True)
    for expected, metric in EXPECTATIONS.items():
        passed = passed & (~F.coalesce(f"wants_{expected}", F.lit(False)) | (F.coalesce(metric, F.lit(0.0)) > 0))
    return got.select(*KEYS, F.coalesce("evidence_patterns", F.lit(0.0)).cast("bigint").alias("evidence_patterns"),
                      F.coalesce("evidence_occurrences", F.lit(0.0)).cast("bigint").alias("evidence_occurrences"),
                      (F.coalesce("has_error_in_result", F.lit(0.0)) > 0).alias("has_error"), passed.alias("passed"))


def with_outcome(metrics: DataFrame, checks: DataFrame) -> DataFrame:
    """The metrics with a ``test_passed`` row for each checked run."""
    row = checks.select(*KEYS, F.lit("test_passed").alias("metric"), F.col("passed").cast("double").alias("value"))
    return metrics.unionByName(row)


def summarise(metrics: DataFrame, by: str = "agent") -> DataFrame:
    """(agent, runs, passed, avg_latency_ms, avg_transitions): one pass over the metric rows, no join."""
    def of(name):
        return F.when(F.col("metric") == name, F.col("value"))
    per_run = metrics.groupBy(by, "run_id").agg(*(F.max(of(m)).alias(m) for m in ("test_passed", "latency_ms", "transitions")))
    return per_run.groupBy(by).agg(F.count("*").alias("runs"), F.count_if(F.col("test_passed") > 0).alias("passed"),
                                   F.avg("latency_ms").alias("avg_latency_ms"), F.avg("transitions").alias("avg_transitions"))
