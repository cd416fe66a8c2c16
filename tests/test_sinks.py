"""Sinks: JSON lines round trip, timestamped report folders, tool payload."""

import json
import os
import tempfile

from loglens.operators import evidence as E
from loglens.operators import sinks as SK

LINES = [("/l/a.log", 1, "24/01/01 00:00:01 ERROR Executor: java.lang.OutOfMemoryError: Java heap space"),
         ("/l/a.log", 2, "24/01/01 00:00:02 WARN TaskSetManager: Lost executor 3 on host"),
         ("/l/b.log", 1, "24/01/01 00:00:03 INFO ok")]


def test_json_round_trip_and_report_runs(spark, lines):
    ev = E.evidence_by_class(lines(LINES))
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    path = SK.sink_json(ev, os.path.join(base, "json"))
    back = spark.read.schema(ev.schema).json(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ev.collect()))
    rep = os.path.join(base, "reports")
    SK.sink_report_tables(ev, rep, run_ts="20240101_000000")
    SK.sink_report_tables(ev, rep, run_ts="20240101_000100")
    runs = spark.read.parquet(rep).groupBy("run_ts").count().collect()
    assert {r.run_ts: r["count"] for r in runs} == {"20240101_000000": ev.count(),
                                                   "20240101_000100": ev.count()}


def test_tool_payload_document(spark, lines):
    doc = json.loads(SK.tool_payload(E.evidence_by_class(lines(LINES))).first().payload)
    assert doc["patterns_found"] == sorted(doc["evidence_map"])
    assert doc["total_matches"] == sum(v["count"] for v in doc["evidence_map"].values())
    assert doc["evidence_map"]["OutOfMemoryError"]["files"] == ["/l/a.log"]
