"""Log-shaped inputs derived from the given tables.

The test tables hold no log text, so log lines, GC lines and case rows are
derived from ``events`` (and ``documents`` / ``conversations``) by pure
projections: no shuffle, one output row per input row, so they grow with the
data. The same derivations exist as SQL in :mod:`loglens.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import table

LOG_TS_FORMAT = "yy/MM/dd HH:mm:ss"


def _s(c: Column) -> Column:
    return c.cast("string")


def event_base(spark, sf_dir: str) -> DataFrame:
    """events -> (event_id, user_id, ts, event_type, v, path)."""
    e = table(spark, sf_dir, "events")
    v = F.floor(F.col("value") * 100).cast("bigint")
    path = F.concat(
        F.lit("/Volumes/logs/service="),
        F.when(F.col("user_id") % 4 == 0, F.lit("driver/driver"))
        .otherwise(F.concat(F.lit("executor/executor-10.0.0."), _s(F.col("user_id") % 8))),
        F.lit(".log"))
    return e.select("event_id", "user_id", "ts", "event_type", v.alias("v"),
                    path.alias("path"))


def log_lines(spark, sf_dir: str, with_case: bool = False) -> DataFrame:
    """Spark-style log lines: (path, line_no, line_text), line_no = event_id;
    ``with_case`` adds ``case_id`` (the user) from the same row."""
    b = event_base(spark, sf_dir)
    v, uid, et = F.col("v"), F.col("user_id"), F.col("event_type")
    body = (F.when(et == "error", F.concat(
                F.lit(" ERROR Executor: Exception in task "), _s(v % 7), F.lit(".0 in stage "),
                _s(v % 3), F.lit(".0 (TID "), _s(F.col("event_id")),
                F.lit("): java.lang.OutOfMemoryError: Java heap space")))
            .when(et == "signup", F.concat(
                F.lit(" WARN TaskSetManager: Lost executor "), _s(uid % 5),
                F.lit(" on worker-1: Container killed")))
            .when(et == "view", F.concat(
                F.lit(" INFO X: FetchFailed partition "), _s(v % 4), F.lit(" at 0xab")))
            .otherwise(F.lit(" INFO BlockManager: ok")))
    line = F.concat(F.date_format("ts", LOG_TS_FORMAT), body)
    extra = [F.col("user_id").alias("case_id")] if with_case else []
    return b.select("path", F.col("event_id").alias("line_no"), line.alias("line_text"), *extra)


def gc_lines(spark, sf_dir: str) -> DataFrame:
    """Unified-logging GC lines: (path, line_no, line_text)."""
    b = event_base(spark, sf_dir)
    v, uid, et, eid = F.col("v"), F.col("user_id"), F.col("event_type"), F.col("event_id")
    desc = (F.when(et == "error", F.lit("Pause Full (System.gc()) "))
            .when(et == "view", F.lit("Concurrent Mark Cycle "))
            .otherwise(F.lit("Pause Young (Normal) (G1 Evacuation Pause) ")))
    mem = F.when(et == "view", F.lit("")).otherwise(F.concat(
        _s(100 + v % 400), F.lit("M->"), _s(v % 200), F.lit("M(512M) ")))
    line = F.concat(
        F.lit("["), _s(eid), F.lit("."), F.lpad(_s(v % 1000), 3, "0"),
        F.lit("s][info][gc] GC("), _s(eid), F.lit(") "), desc, mem,
        _s(v % 2000), F.lit("."), F.lpad(_s(uid % 1000), 3, "0"), F.lit("ms"))
    return b.select("path", eid.alias("line_no"), line.alias("line_text"))


def doc_lines(spark, sf_dir: str) -> DataFrame:
    """documents -> one row per line: (path, line_no, line_text).

    ``path`` is ``doc/<doc_id>`` so that document lines look like a corpus of
    files; line numbers start at 1.
    """
    d = table(spark, sf_dir, "documents")
    return (d.select(F.concat(F.lit("doc/"), _s(F.col("doc_id"))).alias("path"),
                     F.posexplode(F.split("text", "\r\n|\r|\n")))
            .select("path", (F.col("pos") + 1).cast("bigint").alias("line_no"),
                    F.col("col").alias("line_text")))


def json_hit_blobs(spark, sf_dir: str, chunk: int = 8) -> DataFrame:
    """Tool-output-like text: ``Found N hits\n'[{...}, ...]'``.

    Log lines are cut into blobs of ``chunk`` consecutive line numbers (a
    bounded group), each a JSON array of ``{line_text, path, line_no}``
    objects wrapped in chatter and quotes.
    """
    arr = F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "path", "line_text"))),
        lambda s: F.struct(s["line_text"].alias("line_text"), s["path"].alias("path"),
                           s["line_no"].alias("line_no"))))
    return (log_lines(spark, sf_dir)
            .groupBy(F.floor(F.col("line_no") / chunk).alias("blob_id"))
            .agg(F.count("*").alias("n"), arr.alias("arr"))
            .select("blob_id", F.concat(F.lit("Found "), _s(F.col("n")),
                                        F.lit(" hits\n'"), F.col("arr"),
                                        F.lit("'")).alias("blob")))


# ------------------------------------------------------------------ cases --
# FIXED VALUES: how case state is derived from a user's events (fixture
# convention, mirrored by the SQL oracle).
CASE_EVENT_TYPES = ["error", "signup", "view", "click", "purchase"]
CASE_STATUSES = ["", "continue", "summarized"]
CASE_ACTIONS = ["reasoning", "critic", "end", "analyzer", "bogus"]
CASE_CLAIM_KEYS = [("error", "OutOfMemoryError"), ("signup", "Executor_lost"),
                   ("view", "Shuffle_fetch_failure"), ("purchase", "Disk_full")]


def case_lines(spark, sf_dir: str) -> DataFrame:
    """Log lines with the case (user) they belong to (same projection, no join)."""
    return log_lines(spark, sf_dir, with_case=True)


def case_evidence(spark, sf_dir: str) -> DataFrame:
    """(case_id, pattern, count, first_line): class evidence per case."""
    from ..functions.text import class_labels
    return (case_lines(spark, sf_dir)
            .select("case_id", "line_no", F.explode(class_labels("line_text")).alias("pattern"))
            .groupBy("case_id", "pattern")
            .agg(F.count(F.lit(1)).alias("count"), F.min("line_no").alias("first_line")))


def cases(spark, sf_dir: str) -> DataFrame:
    """One investigation case per user, its state derived from the events."""
    b = event_base(spark, sf_dir)
    et = F.col("event_type")
    n = {t: F.count_if(et == t).alias(f"n_{t}") for t in CASE_EVENT_TYPES}
    agg = (b.groupBy(F.col("user_id").alias("case_id"))
           .agg(*n.values(), F.sum("v").alias("_sv"),
                F.min(F.when(et == "error", F.struct("event_id", "path"))).alias("_err")))
    ev = case_evidence(spark, sf_dir)
    sug = (ev.groupBy("case_id")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("first_line", "pattern"))),
                            lambda s: s["pattern"]).alias("suggested")))
    ext = (b.groupBy(F.col("user_id").alias("case_id"), "event_type")
           .agg(F.min("event_id").alias("_f"))
           .groupBy("case_id")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "event_type"))),
                            lambda s: s["event_type"]).alias("existing")))
    c = F.col
    claims = []
    for t in CASE_EVENT_TYPES:
        cnt = c(f"n_{t}")
        claims.append(F.when(cnt > 0, F.concat(
            F.when(cnt >= 3, F.lit("[PROVEN]")).otherwise(F.lit("[INFERRED]")),
            F.lit(f" {t} events: "), cnt.cast("string"), F.lit("."))))
    key_ev = F.array_compact(F.array(*[F.when(c(f"n_{t}") > 0, F.lit(k))
                                       for t, k in CASE_CLAIM_KEYS]))
    pick = lambda values, idx: F.element_at(F.array(*[F.lit(v) for v in values]), idx + 1)
    return (agg.join(sug, "case_id", "left").join(ext, "case_id", "left")
            .select("case_id", *[f"n_{t}" for t in CASE_EVENT_TYPES],
                    (c("n_error") % 8).cast("int").alias("iteration"),
                    pick(CASE_STATUSES, (c("n_view") % 3).cast("int")).alias("last_status"),
                    ((c("_sv") % 100).cast("double") / 100.0).alias("confidence"),
                    (c("n_purchase") % 2 == 1).alias("critic_approved"),
                    pick(CASE_ACTIONS, (c("n_click") % 5).cast("int")).alias("proposed_action"),
                    (c("n_signup") % 8).cast("int").alias("analyze_parse_loops"),
                    (((c("n_click") * 7) % 61 - 30).cast("double") / 100.0).alias("critic_adjust"),
                    (c("n_view") % 2 == 0).alias("critic_approve"),
                    F.when(c("n_error") % 3 == 0, F.lit("")).otherwise(F.lit("Evidence is thin."))
                    .alias("critic_reasons"),
                    F.coalesce(c("_err.path"), F.lit("")).alias("logs_path"),
                    F.concat_ws(" ", *claims).alias("rca"),
                    key_ev.alias("key_evidence"),
                    F.coalesce(c("suggested"), F.array().cast("array<string>")).alias("suggested"),
                    F.coalesce(c("existing"), F.array().cast("array<string>")).alias("existing")))


# FIXED VALUES: patterns that the cases' search requests ask for besides their keywords, by case_id % 5.
CASE_PATTERNS = [r"stage [12]\.0", r"executor \d", "(?P<at>0xab)|heap", "A[", r"(\d)(?<=\1)"]


def case_requests(spark, sf_dir: str) -> DataFrame:
    """(case_id, logs_path, keywords): the search tool's request for each case, keywords as a comma list."""
    c = cases(spark, sf_dir).select("case_id", "logs_path", "existing")
    path = (F.when(F.col("case_id") % 3 == 0, "/Volumes/logs/service=executor/")
            .when(F.col("case_id") % 3 == 1, F.col("logs_path")).otherwise("/Volumes/logs"))
    extra = F.element_at(F.array(*[F.lit(p) for p in CASE_PATTERNS]), (F.col("case_id") % 5 + 1).cast("int"))
    return c.select("case_id", path.alias("logs_path"),
                    F.concat(F.array_join("existing", ", "), F.lit(", "), extra).alias("keywords"))


# FIXED VALUES: how the mixed tree's files are named, and how many lines each has.
TREE_CHUNK = 200
TREE_NAMES = ["plain-{}.log", "sub/deep/plain-{}.log", ".cache/h-{}.log", "sub/.h-{}.log", "_under/_x-{}.log", "sub/bin-{}.dat"]


def write_mixed_tree(lines: DataFrame) -> str:
    r"""Log lines as a tree of files of every kind that a scan's options tell apart; returns its root.

    A file for each ``TREE_CHUNK`` line numbers. By its number it lies in the root, in folders, in a hidden folder, is
    hidden, starts with ``_``, or is binary (a NUL in front of its first line). Line ends go round ``\n``, ``\r\n``
    and ``\r``; every tenth line has bytes that are not valid UTF-8 at both ends.
    """
    import os
    import uuid

    import pyarrow as pa

    from ..session import checkpoint_dir
    from .files import file_system
    root = os.path.join(checkpoint_dir(lines.sparkSession), f"tree-{uuid.uuid4().hex}")

    def write(tab: pa.Table) -> pa.Table:
        chunk = tab["chunk"][0].as_py()
        name = TREE_NAMES[chunk % len(TREE_NAMES)].format(chunk)
        out = b""
        for n, text in sorted(zip(tab["line_no"].to_pylist(), tab["line_text"].to_pylist())):
            body = text.encode()
            out += (b"\xff" + body + b"\xe2\x82" if n % 10 == 3 else body) + (b"\n", b"\r\n", b"\r")[n % 3]
        system, path, _ = file_system(f"{root}/{name}")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path) as f:
            f.write(b"\0" + out if name.endswith(".dat") else out)
        return pa.table({"chunk": [chunk]})

    files = lines.select((F.floor(F.col("line_no") / TREE_CHUNK)).alias("chunk"), "line_no", "line_text")
    files.groupBy("chunk").applyInArrow(write, "chunk bigint").count()
    return root


def learnt_rules(spark, sf_dir: str) -> DataFrame:
    """(symptom, cause, keyword) from the events: users whose errors follow each other, a cyclic rule table."""
    from ..operators.ordered import lag_in_order, slice_by_order
    e = event_base(spark, sf_dir).where("event_type = 'error'").select("event_id", "user_id")
    pairs = lag_in_order(slice_by_order(e, [F.col("event_id")]), "user_id", "before").where("before <> user_id AND before % 3 > 0")
    name = lambda c: F.concat(F.lit("user "), _s(F.col(c)))
    return pairs.select(name("before").alias("symptom"), name("user_id").alias("cause"), F.lit("ERROR").alias("keyword")).distinct()


# FIXED VALUES: the agents and scenarios of the runs, and what the scenarios expect.
RUN_AGENTS = ["parser", "analyzer", "reasoning", "critic", "supervisor"]
RUN_SCENARIOS = ["valid_search", "input_error", "oom_investigation", "anything"]
RUN_EXPECTATIONS = [("valid_search", "has_evidence_map"), ("valid_search", "has_summary"), ("input_error", "has_error"),
                    ("oom_investigation", "has_evidence_map"), ("oom_investigation", "has_error")]


def _run_id() -> Column:
    return F.concat(_s(F.col("user_id")), F.lit("@"), F.date_format("ts", "yyyy-MM-dd"))


def runs(spark, sf_dir: str) -> DataFrame:
    """(run_id, agent, scenario, started_at, ended_at, transitions, success, summary): a user's day of events is a run."""
    e = table(spark, sf_dir, "events")
    of = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("user_id") % len(names) + 1).cast("int"))
    return e.groupBy(_run_id().alias("run_id"), of(RUN_AGENTS).alias("agent"), of(RUN_SCENARIOS).alias("scenario")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("transitions"), F.lit(True).alias("success"),
        F.max(F.when(F.col("event_type") == "purchase", F.lit("bought"))).alias("summary"))


def run_evidence(spark, sf_dir: str) -> DataFrame:
    """(run_id, pattern, count): class evidence of the runs' log lines."""
    from ..functions.text import class_labels
    e = table(spark, sf_dir, "events").select("event_id", _run_id().alias("run_id"))
    lines = log_lines(spark, sf_dir).join(e, F.col("line_no") == F.col("event_id"))
    return (lines.select("run_id", F.explode(class_labels("line_text")).alias("pattern"))
            .groupBy("run_id", "pattern").agg(F.count("*").alias("count")))


def run_expectations(spark) -> DataFrame:
    return spark.createDataFrame(RUN_EXPECTATIONS, "scenario string, expected string")


def marked_lines(spark, sf_dir: str) -> DataFrame:
    """Log lines with markdown marks by their number: headers, lists, blank lines and code fences."""
    n, text = F.col("line_no"), F.col("line_text")
    body = F.when(n % 12 == 3, F.concat(F.lit(" - "), text)).when(n % 12 == 5, "  ").when((n % 12 == 6) & (n % 36 == 6), " ```").when(n % 12 == 6, text)
    for k, mark in enumerate(("# ", "## ", "### ")):
        body = body.when(n % 12 == k, F.concat(F.lit(mark), text))
    body = body.when(n % 12 == 4, F.concat(F.lit("* `"), text, F.lit("` **"), _s(n), F.lit("**")))
    return log_lines(spark, sf_dir).select("path", "line_no", body.otherwise(F.concat(F.lit("- "), text)).alias("line_text"))


def edge_cases(spark, sf_dir: str) -> DataFrame:
    """The cases with inputs, claims and keywords of every kind that the rules tell apart, by case_id.

    Adds ``keywords``, ``problem``, ``mitigation``, ``hypotheses`` and ``suggested_hypotheses``.
    """
    n = F.col("case_id")
    strings = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    existing = (F.when(n % 5 == 0, F.concat("existing", strings("GC overhead"))).when(n % 5 == 1, F.concat("existing", strings("Out of MEMORY")))
                .when(n % 5 == 2, F.concat("existing", strings("ERROR", "exception", "Executor lost", "OutOfMemoryError", "GC overhead", "Container exited"), "suggested"))
                .otherwise(F.col("existing")))
    claims = (F.when(n % 6 == 0, "").when(n % 6 == 1, "[PROVEN] a. [INFERRED] b. [INFERRED] c.").when(n % 6 == 2, "[INFERRED] x.")
              .when(n % 6 == 3, F.repeat(F.lit("[PROVEN] p. "), (n % 8).cast("int"))).otherwise(F.col("rca")))
    keys = (F.when(n % 4 == 0, strings("Disk_full", "No_such_key")).when(n % 4 == 1, strings()).otherwise(F.col("key_evidence")))
    return cases(spark, sf_dir).withColumns({
        "logs_path": F.when(n % 7 == 0, "  ").otherwise(F.concat(F.lit("/Volumes/logs/case-"), _s(n))),
        "keywords": F.when(n % 3 == 0, strings()).otherwise(F.col("existing")),
        "suggested": F.when(n % 5 == 3, strings()).otherwise(F.col("suggested")), "existing": existing, "rca": claims, "key_evidence": keys,
        "problem": F.when(n % 2 == 0, "").otherwise(F.concat(F.lit(" Problem of case "), _s(n))),
        "mitigation": F.when(n % 8 == 1, F.lit(None).cast("string")).otherwise("Raise the limit."),
        "hypotheses": F.when(n % 4 == 0, F.lit(None).cast("array<string>")).otherwise(strings("Heap too small", " skew ", "")),
        "suggested_hypotheses": F.when(n % 3 == 0, strings("SKEW", "Spot loss")).otherwise(F.col("suggested"))})


def edge_evidence(spark, sf_dir: str) -> DataFrame:
    """The cases' class evidence, and for every eleventh case a key that marks unusable input, with a sample line."""
    ev = case_evidence(spark, sf_dir).select("case_id", "pattern", "count")
    ids = cases(spark, sf_dir).where("case_id % 11 = 0").select("case_id")
    bad = ids.select("case_id", F.lit("CRITICAL_ERROR_TOOL").alias("pattern"), F.lit(1).cast("bigint").alias("count"),
                     F.concat(F.lit("The tool failed for case "), _s(F.col("case_id"))).alias("sample"))
    return ev.withColumn("sample", F.lit("")).unionByName(bad)


def gc_edge_lines(spark, sf_dir: str) -> DataFrame:
    """GC lines of one executor for each user: few or many full collections, short and long pauses, low and high heap,
    the words ``Full GC``, sizes in all units, durations in s and ms."""
    b = event_base(spark, sf_dir)
    v, uid, eid, et = F.col("v"), F.col("user_id"), F.col("event_id"), F.col("event_type")
    path = F.concat(F.lit("/Volumes/logs/service=executor/executor-10."), _s(F.floor(uid / 60000)), F.lit("."),
                    _s(F.floor(uid / 250) % 240), F.lit("."), _s(uid % 250), F.lit(".log"))
    full = (et == "error") & ((uid % 3 > 0) | (v % 4 == 0))
    desc = (F.when(full & (uid % 2 == 0), F.lit("Pause Full (Full GC) ")).when(full, F.lit("Pause Full (System.gc()) "))
            .when(et == "signup", F.lit("Pause Remark ")).when(et == "purchase", F.lit("Pause Cleanup "))
            .when((et == "view") & (v % 2 == 0), F.lit("Concurrent Mark Cycle ")).when(et == "view", F.lit("Something else entirely, named at length "))
            .otherwise(F.lit("Pause Young (Normal) (G1 Evacuation Pause) ")))
    mem = (F.when(uid % 5 == 0, F.lit("500M->480M(512M) ")).when(uid % 5 == 1, F.lit("90000K->30000K(524288K) "))
           .when(uid % 5 == 2, F.lit("1.5G->0.5G(2G) ")).otherwise(F.concat(_s(100 + v % 400), F.lit("M->"), _s(v % 200), F.lit("M(512M) "))))
    took = (F.when(uid % 4 == 0, F.concat(_s(v % 2000), F.lit(".5ms"))).when(uid % 4 == 1, F.concat(F.lit("0."), F.lpad(_s(v % 900), 3, "0"), F.lit("s")))
            .otherwise(F.concat(_s(v % 900), F.lit("ms"))))
    line = F.concat(F.lit("["), _s(eid), F.lit(".5s][info][gc] GC("), _s(eid), F.lit(") "), desc, mem, took)
    return b.select(path.alias("path"), eid.alias("line_no"), line.alias("line_text"))
