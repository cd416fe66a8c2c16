"""File-scan and streaming queries of the catalog.

Each query first writes the derived log (or GC) lines of the tables as a
tree of text files under the session's checkpoint folder, then reads that
tree back as a batch scan or as a stream.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gcparse as G
from ..sources import files as FS
from ..sources import fixtures as FX
from ..streaming import queries as ST
from . import oracle as O
from .catalog import GREP_ANY, _ev_template_sql, joined, register
from .catalog_gc import GC_BY_EXEC_SQL
from .oracle import q


def _path_cols(df):
    p = F.col("path")
    return df.select(G.service_from_path(p).alias("service"),
                     G.executor_from_path(p).alias("executor_ip"), "*")


@register("scan_log_lines", "WITH " + O.LOG_LINES + f"""
SELECT {O.service('path')} service, {O.executor('path')} executor_ip,
  CAST(row_number() OVER (PARTITION BY path ORDER BY line_no) AS BIGINT) line_no, line_text FROM ll""")
def scan_log_lines(spark, sf):
    root = FS.write_log_tree(FX.log_lines(spark, sf))
    return _path_cols(FS.scan_lines(spark, root)).select("service", "executor_ip", "line_no",
                                                         "line_text")


_SCAN_SQL = "WITH " + O.LOG_LINES + f"""
SELECT {O.service('path')} service, {O.executor('path')} executor_ip,
  CAST(row_number() OVER (PARTITION BY path ORDER BY line_no) AS BIGINT) line_no, line_text FROM ll"""


# The mixed tree (fixtures.write_mixed_tree): its files and what a scan reads of them.
_TREE_SQL = "WITH " + O.LOG_LINES + """,
f AS (SELECT line_no // 200 chunk, line_no, line_text FROM ll),
tree AS (SELECT chunk % 6 kind, CASE chunk % 6 WHEN 0 THEN 'plain-' || chunk || '.log' WHEN 1 THEN 'sub/deep/plain-' || chunk || '.log'
    WHEN 2 THEN '.cache/h-' || chunk || '.log' WHEN 3 THEN 'sub/.h-' || chunk || '.log' WHEN 4 THEN '_under/_x-' || chunk || '.log'
    ELSE 'sub/bin-' || chunk || '.dat' END file, line_no % 10 = 3 odd,
  CAST(row_number() OVER (PARTITION BY chunk ORDER BY line_no) AS BIGINT) line_no, line_text,
  sum(length(line_text) + CASE line_no % 3 WHEN 1 THEN 2 ELSE 1 END + CASE WHEN line_no % 10 = 3 THEN 3 ELSE 0 END) OVER (PARTITION BY chunk) bytes FROM f)
"""


def _tree(spark, sf, lines=None):
    return FX.write_mixed_tree(FX.log_lines(spark, sf) if lines is None else lines)


def _of_root(df, root):
    """Paths relative to the tree's root."""
    return df.withColumn("file", F.substring_index("path", root.rstrip("/").rpartition("/")[2] + "/", -1)).select("file", "line_no", "line_text")


@register("scan_tree", _TREE_SQL + "SELECT file, line_no, line_text FROM tree WHERE kind IN (0, 1, 4)")
def scan_tree(spark, sf):
    root = _tree(spark, sf)
    return _of_root(FS.scan_lines(spark, root), root)


@register("scan_blocks", _TREE_SQL + "SELECT file, line_no, line_text FROM tree WHERE kind IN (0, 1, 4)")
def scan_blocks(spark, sf):
    # every file in many byte ranges: lines and line ends lie across their edges
    root = _tree(spark, sf)
    return _of_root(FS.scan_lines(spark, root, block_bytes=997), root)


@register("scan_non_recursive", _TREE_SQL + "SELECT file, line_no, line_text FROM tree WHERE kind = 0")
def scan_non_recursive(spark, sf):
    root = _tree(spark, sf)
    return _of_root(FS.scan_lines(spark, root, recursive=False), root)


@register("scan_hidden", _TREE_SQL + "SELECT file, line_no, line_text FROM tree WHERE kind <> 5")
def scan_hidden(spark, sf):
    root = _tree(spark, sf)
    return _of_root(FS.scan_lines(spark, root, include_hidden=True), root)


@register("scan_with_binary", _TREE_SQL + """
SELECT file, line_no, CASE WHEN kind = 5 AND line_no = 1 THEN '<NUL>' ELSE '' END || line_text line_text FROM tree WHERE kind IN (0, 1, 4, 5)""")
def scan_with_binary(spark, sf):
    root = _tree(spark, sf)
    got = FS.scan_lines(spark, root, skip_binary=False)
    return _of_root(got.withColumn("line_text", F.replace("line_text", F.lit("\u0000"), F.lit("<NUL>"))), root)


@register("scan_size_cap", _TREE_SQL + "SELECT file, line_no, line_text FROM tree WHERE kind IN (0, 1, 4) AND bytes <= 14000")
def scan_size_cap(spark, sf):
    root = _tree(spark, sf)
    return _of_root(FS.scan_lines(spark, root, max_bytes_per_file=14_000), root)


@register("scan_latin1", _TREE_SQL + """
SELECT file, line_no, CASE WHEN odd THEN chr(255) || line_text || chr(226) || chr(130) ELSE line_text END line_text FROM tree WHERE kind IN (0, 1, 4)""")
def scan_latin1(spark, sf):
    root = _tree(spark, sf)
    return _of_root(FS.scan_lines(spark, root, encoding="latin-1"), root)


@register("scan_skip_binary", _SCAN_SQL)
def scan_skip_binary(spark, sf):
    # the same lines twice: once as text files, once with a NUL byte at the
    # start of every file; the scan must return the text copy only
    import os
    base = FS.write_log_tree(FX.log_lines(spark, sf))
    FS.write_log_tree(FX.log_lines(spark, sf).withColumn(
        "line_text", F.concat(F.lit("\u0000"), F.col("line_text"))), root=os.path.join(base, "binary-copy"))
    return _path_cols(FS.scan_lines(spark, base)).select("service", "executor_ip", "line_no",
                                                         "line_text")


@register("search_files", _TREE_SQL + f"""
SELECT file, line_no, line_text FROM tree WHERE kind IN (0, 1, 4) AND regexp_matches(line_text, {q('|'.join(f'(?:{p})' for p in GREP_ANY))})""")
def search_files(spark, sf):
    # numbers are resolved for the hits only; ranges of 4 KB, so most hits lie behind a file's first
    root = _tree(spark, sf)
    return _of_root(FS.search_files(spark, root, GREP_ANY, block_bytes=4096), root)


@register("scan_line_numbers", "WITH " + O.LOG_LINES + f"""
SELECT {O.executor('path')} executor_ip, CAST(count(*) AS BIGINT) n_lines, CAST(count(*) AS BIGINT) max_line_no
FROM ll GROUP BY ALL""")
def scan_line_numbers(spark, sf):
    root = FS.write_log_tree(FX.log_lines(spark, sf))
    s = _path_cols(FS.scan_lines(spark, root, recursive=True))
    return s.groupBy("executor_ip").agg(F.count(F.lit(1)).alias("n_lines"),
                                        F.max("line_no").alias("max_line_no"))


@register("stream_grep", "WITH " + O.LOG_LINES + f"""
SELECT {O.executor('path')} executor_ip, line_text FROM ll
WHERE regexp_matches(line_text, {q('|'.join(f'(?:{p})' for p in GREP_ANY))})""")
def stream_grep(spark, sf):
    root = FS.write_log_tree(FX.log_lines(spark, sf))
    return _path_cols(ST.stream_grep(spark, root, GREP_ANY)).select("executor_ip", "line_text")


@register("stream_evidence", "WITH " + O.LOG_LINES + f""",
k AS (SELECT strftime(date_trunc('day', strptime(substr(line_text, 1, 17), '%y/%m/%d %H:%M:%S')), '%Y-%m-%d %H:%M:%S') window_start,
        {O.error_pattern('line_text', False)} pattern FROM ll WHERE {O.strip('line_text')} <> '')
SELECT window_start, pattern, CAST(count(*) AS BIGINT) count FROM k WHERE pattern <> '' GROUP BY ALL""")
def stream_evidence(spark, sf):
    root = FS.write_log_tree(FX.log_lines(spark, sf))
    ev = ST.stream_evidence(spark, root, window="1 day")
    return ev.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                     "pattern", "count")


@register("stream_evidence_map", _ev_template_sql(True) + f""",
every AS (
  SELECT * FROM facts WHERE f <> 'sample' AND v IS NOT NULL AND v <> '' AND f <> 'file'
  UNION ALL SELECT pattern, '_n', '', path, line_no, 0 FROM keyed
  UNION ALL SELECT pattern, 'file', {O.executor('path')}, path, line_no, 0 FROM keyed)
SELECT pattern, CASE f WHEN 'ts' THEN 'timestamps' WHEN 'file' THEN 'files' WHEN 'var' THEN 'variables' ELSE 'lines' END field,
       v "value", CAST(count(*) AS BIGINT) n FROM every GROUP BY pattern, f, v""")
def stream_evidence_map(spark, sf):
    # one file for each executor, one file a trigger, compacted after every third
    root = FS.write_log_tree(FX.log_lines(spark, sf))
    got = ST.stream_evidence_map(spark, root, max_files_per_trigger=1, compact_every=3).read()
    file = F.when(F.col("field") == "files", G.executor_from_path(F.col("value"))).otherwise(F.col("value"))
    return (got.select("pattern", "field", file.alias("value"), "n").groupBy("pattern", "field", "value")
            .agg(F.sum("n").alias("n")))


@register("stream_gc_health", f"""
SELECT executor_ip, total_events, full_gc_count, young_gc_count, max_duration_ms, avg_duration_ms, max_heap_used_pct,
  max_heap_used_bytes, max_duration_sec, health_status, health_issues
FROM ({GC_BY_EXEC_SQL}) bx""")
def stream_gc_health(spark, sf):
    root = FS.write_log_tree(FX.gc_lines(spark, sf))
    h = ST.stream_gc_health(spark, root)
    return h.select("executor_ip", F.col("total_events").cast("bigint").alias("total_events"),
                    F.col("full_gc_count").cast("bigint").alias("full_gc_count"),
                    F.col("young_gc_count").cast("bigint").alias("young_gc_count"),
                    "max_duration_ms", "avg_duration_ms", "max_heap_used_pct",
                    "max_heap_used_bytes", "max_duration_sec", "health_status",
                    joined("health_issues").alias("health_issues"))


@register("stream_gc_intervals", "WITH " + O.GC_EVENTS + """
SELECT coalesce(service, '_') service, timestamp_s,
  timestamp_s - lag(timestamp_s) OVER (PARTITION BY coalesce(service, '_') ORDER BY timestamp_s, event_id) interval_prev_service_s
FROM gev""")
def stream_gc_intervals(spark, sf):
    root = FS.write_log_tree(FX.gc_lines(spark, sf))
    return ST.stream_gc_intervals(spark, root).select("service", "timestamp_s",
                                                       "interval_prev_service_s")
