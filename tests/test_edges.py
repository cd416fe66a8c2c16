"""Queries over the edge fixtures reach their branches: both outcomes, several kinds, no constant column."""

import os

import pytest
from pyspark.sql import functions as F

from loglens.plans import catalog, register_all  # noqa: F401

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")

#: Columns that must take at least so many values.
VARIES = {
    "case_input_errors_edges": {"has_input_error": 2}, "case_needs_gc_edges": {"needs_gc": 2}, "claim_confidence_edges": {"claim_confidence": 3},
    "case_loop_done_edges": {"analyzer_satisfied": 2, "n_new": 3}, "report_evidence_edges": {"pos": 3}, "hypotheses_union": {"hypotheses": 4},
    "case_diagnostic_draft": {"rca": 10}, "case_record": {"problem": 10, "rca": 5, "mitigation": 3, "next_action": 3, "critic_approved": 2, "confidence": 5},
    "gc_parse_edges": {"kind": 6, "stw": 2, "full": 2, "cause": 4, "heap_bytes": 2, "mem_before_str": 5},
    "gc_parse_full_gc_edges": {"line_no": 20}, "gc_health_edges": {"health_status": 3, "health_issues": 4},
    "run_checks": {"has_error": 2, "passed": 2}, "grep_cases": {"error": 3, "which": 5}, "scan_size_cap": {"file": 1},
    "markdown_blocks_marked": {"block_type": 8, "list_id": 10}, "causal_closure": {"depth": 3}, "gc_pause_sketch": {"p50_near": 1},
}


@pytest.mark.parametrize("name", sorted(VARIES))
def test_branches_are_reached(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in VARIES[name]]).first()
    assert all(got[c] is not None and got[c] >= n for c, n in VARIES[name].items()), got
