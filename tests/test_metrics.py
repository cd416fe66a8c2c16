"""Run metrics, expectations and sums on hand-written runs; sketches against exact percentiles."""

import datetime as dt

import pytest

from loglens.operators import gc as GC
from loglens.operators import metrics as MX

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)
RUNS = "run_id string, agent string, scenario string, started_at timestamp, ended_at timestamp, transitions int, success boolean, summary string"


@pytest.fixture()
def metrics(spark):
    runs = spark.createDataFrame([
        ("r1", "parser", "valid", T0, T0 + dt.timedelta(milliseconds=1500), 4, True, "found it"),
        ("r2", "parser", "valid", T0, T0 + dt.timedelta(seconds=1), 2, True, ""),
        ("r3", "critic", "broken", T0, None, 0, False, None),
        ("r4", "critic", "broken", T0, T0, 6, True, None),
        ("r5", "critic", "unknown", T0, T0, 0, True, None)], RUNS)
    ev = spark.createDataFrame([("r1", "WARN", 3), ("r1", "Task_failure", 2), ("r2", "WARN", 1), ("r3", "OutOfMemoryERROR", 7)],
                               "run_id string, pattern string, count bigint")
    return MX.run_metrics(runs, ev)


def test_metrics_are_long(metrics):
    got = {(r.run_id, r.metric): r.value for r in metrics.collect()}
    assert got["r1", "latency_ms"] == 1500.0 and ("r3", "latency_ms") not in got
    assert got["r1", "evidence_patterns"] == 2 and got["r1", "evidence_occurrences"] == 5 and got["r4", "evidence_patterns"] == 0
    assert got["r3", "has_error_in_result"] == 1 and got["r1", "has_error_in_result"] == 0 and got["r3", "success"] == 0
    assert got["r1", "has_summary"] == 1 and got["r2", "has_summary"] == 0 and len(got) == 5 * 7 - 1


def test_expectations_and_sums(spark, metrics):
    wanted = spark.createDataFrame([("valid", "has_evidence_map"), ("valid", "has_summary"), ("broken", "has_error"), ("broken", "no_such_thing")],
                                   "scenario string, expected string")
    checks = MX.check_runs(metrics, wanted)
    got = {r.run_id: (r.evidence_occurrences, r.has_error, r.passed) for r in checks.collect()}
    assert got == {"r1": (5, False, True), "r2": (1, False, False), "r3": (7, True, True), "r4": (0, False, False), "r5": (0, False, True)}
    sums = {r.agent: tuple(r)[1:] for r in MX.summarise(MX.with_outcome(metrics, checks)).collect()}
    assert sums == {"parser": (2, 1, 1250.0, 3.0), "critic": (3, 2, 0.0, 2.0)}


def test_sketches_merge_to_near_percentiles(spark):
    """Merged over windows, in any grouping, the quantiles' true ranks are within the stated error."""
    ev = spark.range(20_000).selectExpr("concat('/l/executor-10.0.0.', id % 3, '.log') AS path", "CAST(id AS double) AS timestamp_s",
                                        "true AS stw", "CAST((id * 7919) % 10007 AS double) AS duration_ms")
    sketches = GC.gc_pause_sketches(ev, window_s=500.0)
    assert sketches.count() == 3 * 40
    err = 3 * GC.sketch_rank_error(200)
    for merged in (GC.merge_sketches(sketches), GC.merge_sketches(GC.merge_sketches(sketches, "executor_ip"))):
        r = GC.sketch_quantiles(merged).first()
        assert r.n == 20_000
        exact = GC.gc_pause_percentiles(ev, ps=(0.5 - err, 0.5 + err, 0.95 - err, 0.99)).first()
        assert exact[0] <= r.p50 <= exact[1] and exact[2] <= r.p95
    assert GC.sketch_rank_error(200) < 0.0134


def test_statistics_without_percentiles_do_no_more_than_one_pass(spark):
    ev = GC.gc_parse(spark.createDataFrame([("/a/driver.log", 1, "[1.5s] GC(1) Pause Full 9M->1M(10M) 3ms"), ("/a/driver.log", 2, "[61.5s] GC(2) Pause Young 9M->1M(10M) 5ms")],
                                           "path string, line_no bigint, line_text string"))
    got = GC.gc_stats(ev, percentiles=False)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "p95_pause_ms" not in got.columns and "ScalarSubquery" not in plan and "scalar-subquery" not in plan
    assert got.first().events_per_min == 2.0
