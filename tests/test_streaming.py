"""Streams equal their batch counterparts; state carries across batches."""

import os
import tempfile
import time


from loglens.streaming import queries as ST


def _write(root, rel, lines, mtime):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    os.utime(path, (mtime, mtime))


def test_gc_intervals_continue_across_micro_batches(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    now = time.time()
    _write(root, "service=a/one.log", [f"[{t}.0s] GC({t}) Pause Young 1M->0M(8M) 2ms" for t in (1, 2, 4)], now - 100)
    _write(root, "service=a/two.log", [f"[{t}.0s] GC({t}) Pause Young 1M->0M(8M) 2ms" for t in (7, 11)], now - 50)
    out = ST.stream_gc_intervals(spark, root, max_files_per_trigger=1)
    got = {r.timestamp_s: r.interval_prev_service_s for r in out.collect()}
    assert got == {1.0: None, 2.0: 1.0, 4.0: 2.0, 7.0: 3.0, 11.0: 4.0}
    assert out.select("batch").distinct().count() == 2


def test_stream_grep_and_evidence(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    lines = ["24/01/01 00:00:01 ERROR Executor: Exception in task 1.0 in stage 2.0 (TID 3)",
             "24/01/01 05:00:00 ERROR Executor: Exception in task 4.0 in stage 2.0 (TID 9)",
             "24/01/02 00:00:00 INFO BlockManager: ok"]
    _write(root, "service=driver/d.log", lines, time.time() - 10)
    hits = ST.stream_grep(spark, root, ["ERROR"])
    assert hits.count() == 2
    ev = {(r.window_start.strftime("%Y-%m-%d"), r.pattern): r["count"]
          for r in ST.stream_evidence(spark, root, strip_prefix=True).collect()}
    assert ev == {("2024-01-01", "Exception in task * in stage * (TID *)"): 2,
                  ("2024-01-02", "ok"): 1}


def test_stream_evidence_merges_counts_across_batches(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    now = time.time()
    _write(root, "service=driver/a.log", ["24/01/02 10:00:00 ERROR X: boom"], now - 100)
    _write(root, "service=driver/b.log", ["24/01/02 09:30:00 ERROR X: boom",
                                          "24/01/02 10:30:00 ERROR X: boom"], now - 50)
    ev = {(r.window_start.strftime("%Y-%m-%d"), r.pattern): r["count"]
          for r in ST.stream_evidence(spark, root, strip_prefix=True,
                                      max_files_per_trigger=1).collect()}
    assert ev == {("2024-01-02", "boom"): 3}


def test_stream_evidence_keeps_late_lines_and_every_timestamp_shape(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    now = time.time()
    _write(root, "service=driver/a.log", ["24/03/09 10:00:00 ERROR X: boom"], now - 100)
    _write(root, "service=driver/b.log", ["24/01/01 09:30:00 ERROR X: boom"], now - 80)    # far behind
    _write(root, "service=driver/c.log", ["2024-01-01  10:30:00 ERROR X: boom",
                                          "24/13/01 10:30:00 ERROR X: boom",               # no such month
                                          "[2024-01-01T11:00:00.5Z] ERROR X: boom",
                                          "1704106800.25 ERROR X: boom",
                                          "99999999999999999999999999.5 ERROR X: boom",
                                          "ERROR X: boom"], now - 60)
    def days(**opts):
        got = ST.stream_evidence(spark, root, strip_prefix=True, **opts)
        out = {}
        for r in got.collect():
            day = r.window_start and r.window_start.strftime("%Y-%m-%d")
            out[day] = out.get(day, 0) + r["count"]
        return out, sorted(map(repr, got.collect()))
    assert days()[0] == {"2024-03-09": 1, "2024-01-01": 4, None: 3}
    assert days() == days(max_files_per_trigger=1)


def test_gc_intervals_equal_batch_when_events_arrive_late(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    now = time.time()
    _write(root, "service=a/one.log", [f"[{t}.0s] GC({t}) Pause Young 1M->0M(8M) 2ms" for t in (7, 11)], now - 100)
    _write(root, "service=a/two.log", [f"[{t}.0s] GC({t}) Pause Young 1M->0M(8M) 2ms" for t in (1, 9)], now - 50)
    out = ST.stream_gc_intervals(spark, root, max_files_per_trigger=1)
    assert {r.timestamp_s: r.interval_prev_service_s for r in out.collect()} == {1.0: None, 7.0: 6.0, 9.0: 2.0, 11.0: 2.0}


def test_gc_health_equals_batch_over_several_triggers(spark):
    from loglens.operators import gc as GC
    from loglens.sources.files import scan_lines
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    now = time.time()
    for k, (kind, ms) in enumerate([("Pause Young", 2), ("Pause Full", 9000), ("Pause Young", 40)]):
        _write(root, f"service=a/exe=executor-10.0.0.1/{k}.log",
               [f"[{k + 1}.0s] GC({k}) {kind} 7M->{k + 1}M(8M) {ms}ms"], now - 100 + k)
    got = ST.stream_gc_health(spark, root, max_files_per_trigger=1)
    want = GC.gc_by_executor(GC.gc_parse(scan_lines(spark, root)))
    assert sorted(got.columns) == sorted(want.columns)
    assert [tuple(r) for r in got.select(*want.columns).collect()] == [tuple(r) for r in want.collect()]


def _facts(df):
    return sorted(((r.pattern, r.field, r.value, r.n, r.first_path.rpartition("/")[2]) for r in df.collect()), key=repr)


def test_evidence_map_equals_batch_over_triggers_and_runs(spark):
    """Files out of order, in several triggers and two runs over one state, compacted in between."""
    from loglens.operators import evidence as E
    from loglens.sources.files import scan_lines
    root, state, chk = (tempfile.mkdtemp(prefix="run-", dir="/tmp") for _ in range(3))
    now = time.time()
    lines = [f"24/01/{1 + i % 9:02} 10:00:0{i % 7} ERROR X: task {i}.0 in stage {i % 3}.0 failed" for i in range(60)] + ["", "no level"]
    names = ["d", "a", "c", "b", "e"]
    def write(which):
        for k in which:
            _write(root, f"service=driver/{names[k]}.log", lines[k * 9:k * 9 + 14], now - 100 + k)
    write([0, 1, 2])
    opts = dict(state=state, checkpoint=chk, max_files_per_trigger=1, compact_every=2)
    first = ST.stream_evidence_map(spark, root, **opts)
    assert first.version() == 1 and first._numbers("delta") == [0, 1, 2]
    assert _facts(first.read()) == _facts(E.evidence_facts(scan_lines(spark, root)))
    write([3, 4])
    table = ST.stream_evidence_map(spark, root, **opts)
    want = _facts(E.evidence_facts(scan_lines(spark, root)))
    assert _facts(table.read()) == want and table.version() == 3
    # a batch is replayed: one that a version holds, and one that is a delta only
    late = E.evidence_facts(scan_lines(spark, root + "/service=driver/e.log")).withColumn("first_line_no", _null())
    for batch in (1, 4):
        table.add(late, batch)
        assert _facts(table.read()) == want
    before = _facts(table.read(2))
    table.compact()
    table.tidy(keep=2)
    assert table._numbers("version") == [3, 4] and table._numbers("delta") == [4]
    assert _facts(table.read()) == want and len(before) < len(want)


def _null():
    from pyspark.sql import functions as F
    return F.lit(None).cast("bigint")


def test_state_passes_over_writes_that_did_not_end(spark):
    from loglens.operators import evidence as E
    from loglens.streaming.state import KeyedState
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rows = spark.createDataFrame([("p", "lines", "", 2, "f", None)], "pattern string, field string, value string, n bigint, first_path string, first_line_no bigint")
    table = KeyedState(spark, root, rows.schema, E.merge_facts)
    assert table.read().collect() == [] and table.compact() == -1
    table.add(rows, 0)
    table.add(rows, 1)
    os.makedirs(f"{root}/version=1")                 # a compaction that was lost on its way
    os.makedirs(f"{root}/delta/batch=2")
    assert [r.n for r in table.read().collect()] == [4] and [r.n for r in table.read(0).collect()] == [2]
    assert table.compact() == 1 and [r.n for r in table.read().collect()] == [4]


def test_gc_intervals_equal_batch_for_any_order_of_files(spark):
    """Late events within slices and over their edges, equal times, repeated lines, two services, small and large slices."""
    import random
    from loglens.operators import gc as GC
    from loglens.sources.files import scan_lines
    rng = random.Random(8)
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    now = time.time()
    for service in ("a", "b"):
        times = [rng.choice([rng.uniform(0, 50), rng.randrange(400), 7]) for _ in range(90)]
        lines = [f"[{t:.3f}s] GC({rng.randrange(5)}) Pause Young 1M->0M(8M) 2ms" for t in times] + ["[7.000s] GC(1) Pause Young 1M->0M(8M) 2ms"] * 3
        lines.append("[1.2.3s] GC(1) Pause Young 1M->0M(8M) 2ms")
        rng.shuffle(lines)
        for k in range(4):
            _write(root, f"service={service}/{k}.log", lines[k::4], now - 100 + rng.randrange(90))
    want = GC.gc_with_intervals(GC.gc_parse(scan_lines(spark, root).withColumn("line_no", _null())))
    key = lambda df: sorted(((r.service, r.path, r.timestamp_s, r.interval_prev_service_s and round(r.interval_prev_service_s, 6)) for r in df.collect()), key=repr)
    expected = key(want)
    assert len(expected) == 188
    for slice_s, files in ((60.0, 1), (5.0, 3), (1000.0, None)):
        assert key(ST.stream_gc_intervals(spark, root, max_files_per_trigger=files, slice_s=slice_s)) == expected
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_gc_interval_state_packs_a_slice_in_few_rows(monkeypatch):
    held, written = [], []

    class Held:
        def get(self):
            return iter(list(held))

        def put(self, rows):
            held[:] = rows
            written.append(len(rows))

    class Handle:
        def getListState(self, name, schema):
            return Held()

    def give(state, times):
        rows = [{"timestamp_s": float(t), "event_id": t, "path": "a", "line_no": None} for t in times]
        out = list(state.handleInputRows(("s", 0), iter(rows), None))
        return len(out), [x for r in out for x in zip(r["timestamp_s"], r["copy"], r["interval"])]

    state = ST.SliceIntervals()
    state.init(Handle())
    assert give(state, range(2, 60, 2)) == (1, [(float(t), 0, 2.0 if t > 2 else None) for t in range(2, 60, 2)])
    # a late one, one that is there already, and parts of 7: they and what is right behind them
    monkeypatch.setattr(ST, "SLICE_PART", 7)
    assert give(state, [2, 5]) == (1, [(2.0, 1, 0.0), (4.0, 0, 2.0), (5.0, 0, 1.0), (6.0, 0, 1.0)])
    assert written == [1, 5] and [len(p[0]) for p in held] == [7, 7, 7, 7, 3]
