"""SQL views and table functions give the rows of the DataFrame functions, without Python in the plan."""

import os

import pytest

from loglens import sql
from loglens.functions.text import class_labels
from loglens.operators import evidence as E
from loglens.operators import gc as GC
from loglens.operators.search import grep
from loglens.sources import fixtures as FX
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_functions_equal_the_operators(spark):
    log, gc = FX.log_lines(spark, SF), FX.gc_edge_lines(spark, SF)
    sql.register(spark, log.unionByName(gc), {"task": r"(?P<t>task) \d+", "odd": "O'Neil|\\\\"})
    every = log.unionByName(gc)
    events = GC.gc_parse(every)
    cols = events.columns
    pairs = [
        ("SELECT * FROM grep('Lost executor [0-2]')", grep(every, [r"Lost executor [0-2]"])),
        ("SELECT * FROM grep_fixed('(TID 1')", grep(every, ["(TID 1"], fixed=True)),
        ("SELECT * FROM grep_named('task')", grep(every, [r"(?P<t>task) \d+"])),
        ("SELECT * FROM grep_named('odd')", grep(every, ["O'Neil|\\\\"])),
        (f"SELECT {', '.join('`%s`' % c for c in cols)} FROM gc_pauses(300.0D, true)", GC.gc_filter(events, 300.0, True)),
        ("SELECT * FROM evidence_of('OutOfMemoryError')", every.where(F.array_contains(class_labels("line_text"), "OutOfMemoryError"))),
        ("SELECT * FROM evidence_like('Exception in task')", E.evidence_facts(every).where("contains(pattern, 'Exception in task')")),
        ("SELECT * FROM gc_by_executor", GC.gc_by_executor(events)),
        ("SELECT pattern, count FROM evidence_by_class", E.evidence_by_class(every).select("pattern", "count")),
    ]
    for text, want in pairs:
        got = spark.sql(text)
        assert rows(got) == rows(want), text
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString(), text
    assert len(rows(pairs[0][1])) > 0 and len(rows(pairs[4][1])) > 0


def test_functions_join_in_sql(spark):
    sql.register(spark, FX.gc_edge_lines(spark, SF))
    got = spark.sql("""SELECT e.executor_ip, count(*) AS slow FROM gc_pauses(500.0D, false) p
                       JOIN gc_by_executor e USING (executor_ip) GROUP BY e.executor_ip ORDER BY slow DESC, executor_ip LIMIT 3""").collect()
    assert len(got) == 3 and got[0].slow >= got[2].slow > 0
    one = got[0].executor_ip
    assert spark.sql(f"SELECT count(*) AS n FROM gc_of('{one}') WHERE duration_ms >= 500").first().n == got[0].slow
