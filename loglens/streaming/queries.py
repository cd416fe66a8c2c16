"""Structured Streaming versions of the search, evidence and GC jobs.

Sources are folders of log files (``readStream.text``); every stream writes
through ``foreachBatch`` into ``<out>/batch=<id>`` with overwrite, so a
replayed micro-batch rewrites the same folder (idempotent, exactly-once
output with the checkpointed offsets). ``trigger(availableNow=True)``
processes what is there and stops; a long-running job uses a processing
time trigger instead.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import text as T
from ..operators import evidence as E
from ..operators import gc as GC
from ..operators.search import grep
from ..session import checkpoint_dir
from .state import KeyedState


def _dirs(spark: SparkSession, name: str) -> tuple[str, str]:
    base = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    return os.path.join(base, "out"), os.path.join(base, "chk")


def read_log_stream(spark: SparkSession, folder: str,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of (path, line_text) from files arriving under ``folder``."""
    r = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    # file metadata gives paths percent-encoded and with a scheme; a batch scan gives them plain
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return r.load(folder).select(F.regexp_replace(path, "^file:/+", "/").alias("path"), F.col("value").alias("line_text"))


def _run(stream: DataFrame, name: str, output_mode: str = "append",
         fold: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Write every micro-batch (or what ``fold`` makes of it) to its own folder."""
    spark = stream.sparkSession
    out, chk = _dirs(spark, name)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        part = fold(batch) if fold else batch
        part.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    q = (stream.writeStream.outputMode(output_mode).foreachBatch(write_batch)
         .option("checkpointLocation", chk).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def stream_grep(spark: SparkSession, folder: str, patterns, **grep_opts) -> DataFrame:
    """Continuous search: stateless filter of new lines, appended per batch."""
    out = _run(grep(read_log_stream(spark, folder), patterns, **grep_opts), "grep")
    return spark.read.parquet(out)


def stream_evidence(spark: SparkSession, folder: str, window: str = "1 day",
                    strip_prefix: bool = False,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Counts per (event-time window, template), equal to a batch run over the same files.

    Each micro-batch is folded to its own counts, and the counts are added when
    they are read. No state is kept between batches, so no line is ever too
    late: there is no watermark. Lines without a timestamp that can be read
    count under a NULL ``window_start``."""
    s = read_log_stream(spark, folder, max_files_per_trigger)
    line = F.col("line_text")
    keyed = (s.where(T.py_strip(line) != "")
             .select(T.event_time(line).alias("event_time"),
                     T.error_pattern(line, strip_prefix=strip_prefix).alias("pattern"))
             .where(F.col("pattern") != ""))

    def fold(batch: DataFrame) -> DataFrame:
        # window() drops NULL times: undated lines get a stand-in time and a flag of their own
        dated = batch.select("pattern", F.col("event_time").isNull().alias("undated"),
                             F.coalesce("event_time", F.timestamp_seconds(F.lit(0))).alias("at"))
        return (dated.groupBy(F.window("at", window).alias("w"), "undated", "pattern")
                .agg(F.count(F.lit(1)).alias("count"))
                .select(F.when(~F.col("undated"), F.col("w.start")).alias("window_start"),
                        "pattern", "count"))

    out = _run(keyed, "evidence", fold=fold)
    return (spark.read.parquet(out).groupBy("window_start", "pattern")
            .agg(F.sum("count").alias("count")))


def stream_evidence_map(spark: SparkSession, folder: str, state: str | None = None, strip_prefix: bool = True,
                        max_files_per_trigger: int | None = None, compact_every: int = 8,
                        checkpoint: str | None = None) -> KeyedState:
    """The all-time evidence of a stream: every pattern's count, timestamps, files and variables.

    Each micro-batch's facts (``evidence.evidence_facts``) are added to a keyed state under the batch's id and merged
    with ``evidence.merge_facts``, so a replayed batch changes nothing and files may arrive in any order.
    With ``state`` and ``checkpoint`` of an earlier run the stream goes on where it stopped. Lines have
    no number on a stream, so ``first_line_no`` is null; all else equals a batch run over the same files.
    """
    out, chk = _dirs(spark, "evidence-map")
    shape = spark.createDataFrame([], "path string, line_no bigint, line_text string")
    table = KeyedState(spark, state or out, E.evidence_facts(shape, strip_prefix=strip_prefix).schema, E.merge_facts)

    def add(batch: DataFrame, batch_id: int) -> None:
        lines = batch.withColumn("line_no", F.lit(None).cast("bigint"))
        table.add(E.evidence_facts(lines, strip_prefix=strip_prefix), batch_id)
        if (batch_id + 1) % compact_every == 0:
            table.compact()

    q = (read_log_stream(spark, folder, max_files_per_trigger).writeStream.foreachBatch(add)
         .option("checkpointLocation", checkpoint or chk).trigger(availableNow=True).start())
    q.awaitTermination()
    return table


# Events as parallel lists, at most SLICE_PART of them in a row: a row of state or output costs far more than an event in it.
SLICE_PART = 10_000
_HELD = "timestamp_s array<double>, event_id array<bigint>, path array<string>"
_FOUND = f"service string, slice bigint, {_HELD}, copy array<int>, interval array<double>"
_PLACED = "service string, slice bigint, timestamp_s double, event_id bigint, path string, copy int, interval double"


def _event_order(e: tuple) -> tuple:
    """Order of events with equal times as in a batch: event id, path; a missing one counts as 0 or empty."""
    return e[0], e[1] or 0, e[2] or ""


def _parts(events: list[tuple]) -> list[tuple]:
    """The events' fields as lists, ``SLICE_PART`` events to a row."""
    return [tuple(map(list, zip(*events[i:i + SLICE_PART]))) for i in range(0, len(events), SLICE_PART)]


class SliceIntervals(StatefulProcessor):
    """State of one (service, time slice): its events in order.

    New events are put in their places; what is given out are they and the events right behind them, whose
    interval they change. The first event of a slice has no interval here.
    """

    def init(self, handle):
        self.events = handle.getListState("events", _HELD)

    def handleInputRows(self, key, rows, timerValues):
        service, at = key
        held = [e for part in self.events.get() for e in zip(*part)]
        fresh = sorted(((r["timestamp_s"], r["event_id"], r["path"]) for r in rows), key=_event_order)
        every = sorted(((e, new) for new, events in ((False, held), (True, fresh)) for e in events), key=lambda x: (_event_order(x[0]), x[1]))
        copies: dict[tuple, int] = {}
        out, before, moved = [], None, False
        for e, new in every:
            copies[e] = copy = copies.get(e, -1) + 1
            if new or moved:
                out.append((*e, copy, None if before is None else e[0] - before))
            before, moved = e[0], new
        self.events.put(_parts([e for e, _ in every]))
        return (Row(service=service, slice=at, timestamp_s=t, event_id=i, path=p, copy=c, interval=d) for t, i, p, c, d in _parts(out))

    def close(self):
        pass


@contextlib.contextmanager
def _state_in_rocksdb(spark: SparkSession):
    """Keyed state of our own needs this store; the session's setting is put back once the stream has started."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was) if was is not None else spark.conf.unset(name)


def stream_gc_intervals(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None,
                        slice_s: float = 60.0) -> DataFrame:
    """Interval to the previous GC event of the same service, equal to a batch run over the same files.

    The stream keeps state for each (service, slice of ``slice_s`` seconds), so a service with most of the
    events is spread over as many tasks as it has slices. A batch gives out its new events with their interval
    within the slice, and again the events behind them, corrected: an event that comes late costs
    its slice, no more. Reading takes each event's latest row and, for the first event of a slice, the
    last time of the service's slice before it: a table of one row for each slice is ordered, the events
    are not. Events without a readable time have no interval. ``batch`` is the micro-batch that brought the event.
    """
    s = read_log_stream(spark, folder, max_files_per_trigger)
    ev = GC.gc_parse(s.withColumn("line_no", F.lit(None).cast("bigint")))
    slot = F.coalesce(F.floor(F.col("timestamp_s") / F.lit(float(slice_s))), F.lit(-1)).cast("bigint")
    keyed = ev.select(F.coalesce("service", F.lit("_")).alias("service"), slot.alias("slice"), "timestamp_s", "event_id", "path")
    undated = F.col("timestamp_s").isNull()
    timed = (keyed.where(~undated).groupBy("service", "slice")
             .transformWithState(SliceIntervals(), _FOUND, "append", "none")
             .select("service", "slice", F.inline(F.arrays_zip("timestamp_s", "event_id", "path", "copy", "interval"))))
    with _state_in_rocksdb(spark):
        out = _run(timed, "gcint")
    rows = spark.read.schema(f"{_PLACED}, batch int").parquet(out)
    # events without a time need no state
    plain = spark.read.schema("service string, path string, batch int").parquet(
        _run(keyed.where(undated).select("service", "path"), "gcundated"))
    key = ["service", "slice", "timestamp_s", "event_id", "path", "copy"]
    latest = rows.groupBy(*key).agg(F.max_by(F.struct("interval"), "batch").alias("r"), F.min("batch").alias("batch"))
    ends = latest.groupBy("service", "slice").agg(F.max("timestamp_s").alias("last"))
    carry = ends.select("service", "slice", F.lag("last").over(Window.partitionBy("service").orderBy("slice")).alias("before"))
    got = latest.join(carry, ["service", "slice"])
    interval = F.coalesce(F.col("r.interval"), F.col("timestamp_s") - F.col("before"))
    # lines have no number on a stream
    return (got.select("service", "path", "timestamp_s", interval.alias("interval_prev_service_s"), "batch")
            .unionByName(plain, allowMissingColumns=True)
            .select("service", "path", F.lit(None).cast("bigint").alias("line_no"), "timestamp_s", "interval_prev_service_s", "batch"))


def stream_gc_health(spark: SparkSession, folder: str,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Per-executor GC aggregates maintained incrementally (update mode), with
    the columns of :func:`loglens.operators.gc.gc_by_executor`; the last
    emitted row of an executor is its current state."""
    from ..functions.gcparse import executor_from_path
    s = read_log_stream(spark, folder, max_files_per_trigger)
    ev = GC.gc_parse(s.withColumn("line_no", F.lit(None).cast("bigint")))
    dur = F.when(F.col("duration_ms") >= 0, F.col("duration_ms"))
    heap_pct = F.when((F.col("heap_bytes") > 0) & (F.col("mem_after_bytes") >= 0),
                      F.col("mem_after_bytes") / F.col("heap_bytes") * 100.0)
    after = F.when(F.col("mem_after_bytes") >= 0, F.col("mem_after_bytes"))
    agg = (ev.withColumn("executor_ip", executor_from_path(F.col("path")))
           .groupBy("executor_ip")
           .agg(F.count(F.lit(1)).alias("total_events"),
                F.count_if(F.col("full")).alias("full_gc_count"),
                F.count_if(F.col("kind") == "pause_young").alias("young_gc_count"),
                F.coalesce(F.max(dur), F.lit(0.0)).alias("max_duration_ms"),
                F.coalesce(F.avg(dur), F.lit(0.0)).alias("avg_duration_ms"),
                F.coalesce(F.max(heap_pct), F.lit(0.0)).alias("max_heap_used_pct"),
                F.coalesce(F.max(after), F.lit(0)).cast("bigint").alias("max_heap_used_bytes")))
    rows = spark.read.parquet(_run(agg, "gchealth", "update")).drop("batch")
    # an executor's count grows with every row that is emitted for it
    latest = (rows.groupBy("executor_ip")
              .agg(F.max_by(F.struct(*rows.drop("executor_ip").columns), "total_events").alias("s"))
              .select("executor_ip", "s.*"))
    return GC.gc_health(latest.withColumn("max_duration_sec", F.col("max_duration_ms") / 1000.0))
