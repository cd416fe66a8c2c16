"""Physical-plan guards for the scale properties (plans only, no execution
for the lazy queries)."""

import pytest

import __spark_entry__ as entry
from loglens.functions import gcparse as G

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
# builders that run jobs while planning (checkpoints, file writes, streams,
# keyword lists): their plans are checked elsewhere
EAGER = ("gc_interval", "gc_sorted", "report_gc_main", "stream_", "scan_", "sink_",
         "grep_keyword_table", "gc_pause_percentiles")


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(EAGER)))
def test_no_cross_join(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_search_is_narrow(spark):
    p = plan(spark, "grep_any")
    assert "hashpartitioning" not in p and "rangepartitioning" not in p


@pytest.mark.parametrize("name", ["evidence_by_class", "evidence_by_template"])
def test_first_k_lists_use_window_group_limit(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_gc_shapes_evaluated_once(spark):
    p = plan(spark, "gc_parse")
    for shape in ("A", "B", "C"):
        rx, _ = G._packer(shape)
        assert p.count(rx) == 1, shape
