"""Evidence maps against a brute-force fold over the lines in arrival order."""

import random
import re

from loglens.functions import patterns as P
from loglens.operators import evidence as E


def _lines(n=300, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        ts = f"25/10/0{rnd.randint(1, 3)} 06:{rnd.randint(0, 59):02d}:{rnd.randint(0, 59):02d}"
        body = rnd.choice([
            f" ERROR Executor: Exception in task {rnd.randint(0, 9)}.0 in stage {rnd.randint(0, 3)}.0 (TID {i})",
            f" WARN TaskSetManager: Lost executor {rnd.randint(0, 4)} on worker-{rnd.randint(1, 3)}",
            " INFO X: FetchFailed partition 3 at 0xAB12 on Thread-7",
            " INFO BlockManager: ok",
            " ERROR Driver: Connection refused to 10.1.2.3",
        ])
        out.append((f"/logs/f{rnd.randint(0, 4)}.log", i, ts + body))
    return out


def _brute_by_class(rows):
    ev = {}
    for path, ln, line in sorted(rows, key=lambda r: (r[0], r[1])):
        ts = None
        for rx in P.SHORT_TS_PATTERNS:
            m = re.search(rx, line)
            if m:
                ts = m.group(1)
                break
        for name, rx in P.CLASS_RULES:
            if not re.search(rx, line, re.IGNORECASE):
                continue
            e = ev.setdefault(name, {"count": 0, "ts": set(), "files": set(), "samples": [], "vars": set()})
            e["count"] += 1
            if ts:
                e["ts"].add(ts)
            e["files"].add(path)
            if len(e["samples"]) < 3:
                e["samples"].append(line)
            for vrx, kind in P.TYPED_VARIABLE_RULES:
                m = re.search(vrx, line, re.IGNORECASE)
                if m:
                    e["vars"].add(f"{kind}:{m.group(1)}")
    return {k: (v["count"], sorted(v["ts"])[:10], sorted(v["files"])[:5], v["samples"],
                sorted(v["vars"])[:10]) for k, v in ev.items()}


def test_by_class_matches_brute_force(lines):
    rows = _lines()
    got = {r.pattern: (r["count"], list(r.timestamps), list(r.files), list(r.sample_lines),
                       list(r.variables)) for r in E.evidence_by_class(lines(rows)).collect()}
    assert got == _brute_by_class(rows)


def _brute_by_template(rows):
    ev = {}
    for path, ln, line in sorted(rows, key=lambda r: (r[0], r[1])):
        if not line.strip():
            continue
        key = line.strip()
        if any(lv in line for lv in P.LOG_LEVELS) and ":" in line:
            msg = line.split(":", 1)[1].strip()
            for rx, rep in P.NORMALIZE_RULES:
                msg = re.sub(rx, rep, msg, flags=re.IGNORECASE)
            key = msg
        if not key:
            continue
        ts = None
        m = re.match(P.FULL_TS_PATTERNS[0], line)
        if m:
            ts = m.group(1)
        e = ev.setdefault(key, {"count": 0, "ts": [], "files": [], "samples": [], "vars": []})
        e["count"] += 1
        if ts and ts not in e["ts"]:
            e["ts"].append(ts)
        if path not in e["files"]:
            e["files"].append(path)
        if len(e["samples"]) < 3 and line not in e["samples"]:
            e["samples"].append(line)
        for rx, _ in P.NORMALIZE_RULES:
            for v in re.findall(rx, line, flags=re.IGNORECASE):
                if len(e["vars"]) < 20 and v not in e["vars"]:
                    e["vars"].append(v)
    return {k: (v["count"], v["ts"][:10], len(v["ts"]), v["files"][:5], v["samples"], v["vars"])
            for k, v in ev.items()}


def test_by_template_compat_matches_brute_force(lines):
    rows = _lines()
    got = {r.pattern: (r["count"], list(r.timestamps), r.n_timestamps, list(r.files),
                       list(r.sample_lines), list(r.variables))
           for r in E.evidence_by_template(lines(rows), strip_prefix=False).collect()}
    assert got == _brute_by_template(rows)


def test_strip_prefix_keys_on_message(lines):
    rows = [("a", 1, "25/10/08 06:23:27 WARN DriverCorral$: Short-term memory (STM) sync requested"),
            ("a", 2, "25/10/08 06:23:28 ERROR Executor: Lost executor 12 on host")]
    keys = sorted(r.pattern for r in E.evidence_by_template(lines(rows)).collect())
    assert keys == ["Lost executor * on host", "Short-term memory (STM) sync requested"]


def _norm(df):
    return sorted((r.pattern, r["count"], tuple(r.timestamps), tuple(r.files), tuple(r.sample_lines),
                   tuple(r.variables)) for r in df.collect())


def test_merge_is_associative_and_matches_whole(lines):
    rows = _lines(240, seed=11)
    parts = [lines(rows[i::3]) for i in range(3)]
    a, b, c = (E.evidence_by_class(p) for p in parts)
    left = E.evidence_merge(E.evidence_merge(a, b), c)
    right = E.evidence_merge(a, E.evidence_merge(b, c))
    assert _norm(left) == _norm(right)
    whole = {r.pattern: r["count"] for r in E.evidence_by_class(lines(rows)).collect()}
    assert {r.pattern: r["count"] for r in left.collect()} == whole


def test_invariant_under_repartition(lines):
    rows = _lines(200, seed=5)
    df = lines(rows)
    one = _norm(E.evidence_by_template(df.coalesce(1), strip_prefix=False))
    many = _norm(E.evidence_by_template(df.repartition(7), strip_prefix=False))
    assert one == many


def test_stats_totals_top(lines):
    rows = _lines(150, seed=2)
    ev = E.evidence_by_template(lines(rows), strip_prefix=False)
    st = E.evidence_stats(ev).first()
    counts = [r["count"] for r in ev.collect()]
    assert st.total_unique_patterns == len(counts) and st.total_occurrences == 150
    assert st.avg_occurrences_per_pattern == 150 // len(counts)
    top = E.evidence_top(ev, 3).collect()
    assert [r["rank"] for r in top] == [1, 2, 3] and top[0]["count"] == max(counts)
    tot = E.evidence_totals(lines(rows)).first()
    assert tot.label_matches >= tot.line_matches


def test_facts_keep_every_timestamp_and_file(lines):
    rows = [(f"f{i:02d}", 1, f"24/01/01 10:00:{i:02d} ERROR Worker: disk full") for i in range(12)]
    facts = E.evidence_facts(lines(rows)).collect()
    assert len({r.pattern for r in facts}) == 1
    by = {f: {r["value"] for r in facts if r.field == f} for f in ("timestamps", "files")}
    assert len(by["timestamps"]) == 12 and by["files"] == {f"f{i:02d}" for i in range(12)}
    assert [r.n for r in facts if r.field == "lines"] == [12]
    st = E.facts_stats(E.evidence_facts(lines(rows))).first()
    assert tuple(st) == (1, 12, 12, 12)


def test_facts_stats_of_no_hits(lines):
    assert tuple(E.facts_stats(E.evidence_facts(lines([("a", 1, "x")]).limit(0))).first()) == (0, 0, 0, 0)


def test_by_template_query_keeps_every_value(spark, tmp_path):
    """More timestamps, files and variables of one pattern than any list used to hold."""
    import datetime

    import __spark_entry__ as entry
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(seconds=i // 2), i % 9, "error", 0.0) for i in range(60)]
    rows += [(60 + i, day, 1, "click", 1.0) for i in range(3)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.pattern: r for r in entry.queries()["evidence_by_template"](spark, str(tmp_path)).collect()}
    hot = next(r for p, r in got.items() if "OutOfMemoryError" in p)
    shown = {c: hot[c].split("|") for c in ("timestamps", "files", "sample_lines", "variables")}
    arrived = sorted((f"/Volumes/logs/service={'driver/driver' if u % 4 == 0 else f'executor/executor-10.0.0.{u % 8}'}.log", i, t) for i, t, u, e, _ in rows if e == "error")
    assert shown["files"] == list(dict.fromkeys(p for p, _, _ in arrived)) and len(shown["files"]) == hot.n_files == 7
    assert shown["timestamps"] == list(dict.fromkeys(t.strftime("%y/%m/%d %H:%M:%S") for _, _, t in arrived)) and len(shown["timestamps"]) == hot.n_timestamps == 30
    assert len(set(shown["variables"])) == hot.n_variables > 60 and {f"TID {i}" for i in range(60)} <= set(shown["variables"])
    assert hot["count"] == 60 and len(shown["sample_lines"]) == 3 and len(got) == 2
