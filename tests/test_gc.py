"""GC parsing on the hand-written shapes, against a brute-force Python
reading of the same rules."""

import math

from pyspark.sql import functions as F

from loglens.operators import gc as GC

FIXTURE = [
    ("/v/service=executor/executor-10.0.0.1.log", 1,
     "[12.345s][info][gc] GC(5) Pause Young (Normal) (G1 Evacuation Pause) 24M->4M(256M) 3.456ms"),
    ("/v/service=executor/executor-10.0.0.1.log", 2,
     "[13.0s] GC(6) Pause Full (System.gc()) 1.5s 1,024M->100M(2G)"),
    ("/v/service=driver/driver.log", 1, "[14.1s][info][gc] GC(7) Concurrent Mark Cycle 12.3ms"),
    ("/v/service=driver/driver.log", 2, "[15s] GC(8) Pause Remark 30M->30M(256M) 1.2.3ms"),
    ("/v/service=driver/driver.log", 3, "[16.5s] GC(9) Pause Cleanup 10MB->9MB(256MB) 0.5ms"),
    ("/v/service=driver/driver.log", 4, "no gc here"),
]


def test_shapes_sizes_durations(lines):
    rows = {r.event_id: r for r in GC.gc_parse(lines(FIXTURE)).collect()}
    assert set(rows) == {5, 6, 7, 8, 9}
    a = rows[5]
    assert (a.timestamp_s, a.duration_ms, a.mem_before_bytes, a.mem_after_bytes, a.heap_bytes) == \
        (12.345, 3.456, 24 * 2**20, 4 * 2**20, 256 * 2**20)
    assert (a.kind, a.kind_short, a.stw, a.full) == ("pause_young", "Young", True, False)
    assert a.cause == "Normal | G1 Evacuation Pause"
    assert a.freed_mb_str == "20MB" and math.isclose(a.freed_pct, 20 / 256)
    b = rows[6]                     # duration before the memory triple, commas in sizes
    assert (b.duration_ms, b.mem_before_bytes, b.heap_bytes, b.full) == \
        (1500.0, 1024 * 2**20, 2 * 2**30, True)
    c = rows[7]                     # duration only
    assert (c.kind, c.stw, c.mem_before_str, c.mem_before_bytes, c.freed_mb_str) == \
        ("concurrent", False, "?", None, "?")
    assert rows[8].duration_ms is None          # "1.2.3ms" does not parse
    assert rows[9].mem_before_str == "?"        # "10MB" misses the memory shapes (shape C)
    assert rows[9].service == "driver" and rows[5].service == "executor"


def test_intervals_match_brute_force(spark, lines):
    import random
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        svc = rnd.choice(["driver", "executor", None])
        path = f"/v/service={svc}/x.log" if svc else "/v/other/x.log"
        ts = round(rnd.uniform(0, 50), 3)
        rows.append((path, i, f"[{ts}s][gc] GC({rnd.randint(0, 30)}) Pause Young {rnd.randint(1, 99)}ms"))
    ev = GC.gc_parse(lines(rows))
    got = {(r.path, r.line_no): (r.interval_prev_s, r.interval_prev_service_s)
           for r in GC.gc_with_intervals(ev, slices=5).collect()}
    parsed = [(r.service, r.timestamp_s, r.event_id, r.path, r.line_no) for r in ev.collect()]
    parsed.sort(key=lambda x: (x[0] or "", x[1], x[2], x[3], x[4]))
    last_g, last_s, want = None, {}, {}
    for svc, ts, eid, p, ln in parsed:
        g = svc or "_"
        want[(p, ln)] = (None if last_g is None else ts - last_g,
                         None if g not in last_s else ts - last_s[g])
        last_g, last_s[g] = ts, ts
    assert set(got) == set(want)
    for k, (a, b) in want.items():
        ga, gb = got[k]
        assert (ga is None) == (a is None) and (a is None or math.isclose(ga, a, abs_tol=1e-9))
        assert (gb is None) == (b is None) and (b is None or math.isclose(gb, b, abs_tol=1e-9))


def test_sorted_positions_are_a_permutation(lines):
    ev = GC.gc_parse(lines(FIXTURE))
    pos = sorted(r.pos for r in GC.gc_sorted(ev, "duration", slices=3).collect())
    assert pos == [1, 2, 3, 4, 5]
    top = [r.event_id for r in GC.gc_top(ev, "duration", 2).collect()]
    assert top == [6, 7]


def test_stats_and_health(lines):
    ev = GC.gc_parse(lines(FIXTURE))
    st = GC.gc_stats(ev).first()
    assert (st.total_events, st.stw_events, st.full_gc, st.young_gc, st.concurrent_events) == (5, 4, 1, 1, 1)
    durs = sorted([3.456, 1500.0, 0.5])         # STW with a known duration
    assert math.isclose(st.p50_pause_ms, durs[1])
    assert math.isclose(st.observed_span_s, 16.5 - 12.345)
    ex = {r.executor_ip: r for r in GC.gc_by_executor(ev).collect()}
    assert set(ex) == {"10.0.0.1", "driver"}
    assert ex["10.0.0.1"].health_status.endswith("Heavy GC activity")   # 1.5 s pause
    assert list(ex["10.0.0.1"].health_issues) == ["Long pause (1.50s)"]


def test_executor_ip_compat_keeps_trailing_dot(spark):
    from loglens.functions.gcparse import executor_from_path
    df = spark.createDataFrame([("/x/executor-10.0.0.1.log",), ("/x/Driver/y",), ("/x/z",)], "p string")
    got = [r[0] for r in df.select(executor_from_path(F.col("p"))).collect()]
    compat = [r[0] for r in df.select(executor_from_path(F.col("p"), compat=True)).collect()]
    assert got == ["10.0.0.1", "driver", "unknown"]
    assert compat[0] == "10.0.0.1."


def test_config_from_corpus(lines):
    rows = [("a", 1, "JVM flags -Xms1g -Xmx8G -XX:+UseG1GC"), ("a", 2, "GC(1) 10M->5M(4096M)")]
    got = {r.parameter: r.value for r in GC.gc_config(lines(rows)).collect()}
    assert got == {"Max Heap Size": "8.0 GB (-Xmx8G)", "GC Algorithm": "G1 Garbage Collector"}
    rows = [("a", 1, "PSYoungGen GC(1) 10M->5M(1536M) -Xmx512K")]
    got = {r.parameter: r.value for r in GC.gc_config(lines(rows)).collect()}
    assert got == {"Max Heap Size": "1.5 GB (~observed)", "GC Algorithm": "Parallel GC"}


def test_rank_percentiles_match_python(spark):
    import random
    from loglens.operators.ordered import rank_percentiles
    rnd = random.Random(1)
    xs = [float(rnd.choice([1, 2, 2, 2, 3, 50, rnd.randint(0, 999)])) for _ in range(997)]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "x double, i long")
    got = rank_percentiles(df, "x", [0.0, 0.5, 0.95, 0.99, 1.0], slices=6).first()
    s = sorted(xs)

    def q(p):
        k = p * (len(s) - 1)
        lo, hi = int(k), min(int(k) + 1, len(s) - 1)
        return s[lo] * (1 - (k - lo)) + s[hi] * (k - lo)
    for i, p in enumerate([0.0, 0.5, 0.95, 0.99, 1.0]):
        assert math.isclose(got[f"p{i}"], q(p), rel_tol=1e-12)


def test_rank_percentiles_of_one_value_repeats_and_nothing(spark):
    from loglens.operators.ordered import rank_percentiles

    def of(xs):
        return tuple(rank_percentiles(spark.createDataFrame([(x,) for x in xs], "x double"), "x", [0.0, 0.5, 0.99]).first())
    assert of([7.0]) == (7.0, 7.0, 7.0)
    assert of([3.0] * 50 + [None]) == (3.0, 3.0, 3.0)
    assert of([1.0, 2.0])[:2] == (1.0, 1.5)
    assert of([]) == of([None]) == (None, None, None)


def test_long_lines_without_gc_cost_no_regex(spark):
    """A line that only looks like a duration list is ruled out before the lazy patterns run over it."""
    import time
    from loglens.operators.gc import gc_parse
    line = "took 12s in stage " * 350
    df = spark.range(4000).selectExpr("'p' AS path", "id AS line_no", f"'{line}' AS line_text")
    t = time.time()
    assert gc_parse(df).count() == 0
    assert time.time() - t < 20
