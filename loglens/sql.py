"""The search, evidence and GC jobs for SQL users: views and SQL table functions over a table of lines.

``register(spark, lines)`` makes temporary views that hold no data (each query plans through them)

    log_lines, gc_events, evidence_by_class, evidence_by_template, evidence_facts, gc_by_executor

and table functions, all Catalyst expressions, no Python in a query:

    grep(pattern)                 lines that a regular expression of Spark's engine matches
    grep_fixed(text)              lines that hold a text
    gc_pauses(min_ms, only_stw)   GC events at or over a duration
    gc_of(executor)               GC events of one executor
    evidence_of(class)            the lines of one evidence class
    evidence_like(part)           the facts of the templates that hold a text

With ``python_patterns`` a name is bound to the translation of a Python pattern and ``grep_named(name)`` searches for it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import regex as R
from .functions import text as T
from .functions.gcparse import executor_from_path
from .operators import evidence as E
from .operators import gc as GC

_LINE = "path STRING, line_no BIGINT, line_text STRING"


def _table_function(spark: SparkSession, name: str, params: str, returns: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS TABLE({returns}) RETURN {body}")


def register(spark: SparkSession, lines: DataFrame, python_patterns: Mapping[str, str] | None = None) -> None:
    """Views and table functions over ``lines`` (path, line_no, line_text); those of an earlier call are replaced."""
    lines.select("path", "line_no", "line_text").createOrReplaceTempView("log_lines")
    events = GC.gc_parse(lines).withColumn("executor_ip", executor_from_path(F.col("path")))
    events.createOrReplaceTempView("gc_events")
    GC.gc_by_executor(events.drop("executor_ip")).createOrReplaceTempView("gc_by_executor")
    E.evidence_by_class(lines).createOrReplaceTempView("evidence_by_class")
    E.evidence_by_template(lines).createOrReplaceTempView("evidence_by_template")
    E.evidence_facts(lines).createOrReplaceTempView("evidence_facts")
    (lines.select("path", "line_no", "line_text", F.explode(T.class_labels("line_text")).alias("class"))
     .createOrReplaceTempView("classified_lines"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    facts = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.table("evidence_facts").schema)

    _table_function(spark, "grep", "pattern STRING", _LINE, "SELECT * FROM log_lines WHERE line_text RLIKE pattern")
    _table_function(spark, "grep_fixed", "part STRING", _LINE, "SELECT * FROM log_lines WHERE contains(line_text, part)")
    _table_function(spark, "gc_pauses", "min_ms DOUBLE, only_stw BOOLEAN", schema,
                    "SELECT * FROM gc_events WHERE duration_ms >= min_ms AND (stw OR NOT only_stw)")
    _table_function(spark, "gc_of", "executor STRING", schema, "SELECT * FROM gc_events WHERE executor_ip = executor")
    _table_function(spark, "evidence_of", "wanted STRING", _LINE, "SELECT path, line_no, line_text FROM classified_lines WHERE class = wanted")
    _table_function(spark, "evidence_like", "part STRING", facts, "SELECT * FROM evidence_facts WHERE contains(pattern, part)")
    named = {n: R.to_java(p) for n, p in (python_patterns or {}).items()}
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cases = "".join(f" WHEN {quoted(n)} THEN line_text RLIKE {quoted(p)}" for n, p in named.items())
    _table_function(spark, "grep_named", "name STRING", _LINE,
                    f"SELECT * FROM log_lines WHERE CASE name{cases} ELSE false END" if cases else "SELECT * FROM log_lines WHERE false")
