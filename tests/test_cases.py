"""Case policy rules on hand-written case rows (the five supervisor states,
critic verdicts and loop stops of the original test fixtures, as rows)."""

from pyspark.sql import functions as F

from loglens.operators import cases as C

SCHEMA = ("case_id bigint, iteration int, last_status string, confidence double, "
          "critic_approved boolean, proposed_action string")


def test_next_action_policy(spark):
    rows = [(1, 0, "", 0.0, False, "end"),              # first pass -> reasoning
            (2, 2, "summarized", 0.7, False, "bogus"),  # draft not yet checked -> critic
            (3, 3, "summarized", 0.8, True, "nonsense"),  # approved, confident -> end
            (4, 3, "summarized", 0.6, True, "nonsense"),  # approved, not confident -> reasoning
            (5, 6, "continue", 0.9, False, "reasoning"),  # iteration cap -> end
            (6, 2, "continue", 0.5, False, " Reasoning ")]  # proposal allowed -> taken
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.case_id: (r.next_action, r.new_iteration) for r in C.next_action(df).collect()}
    assert got == {1: ("reasoning", 1), 2: ("critic", 2), 3: ("end", 3), 4: ("reasoning", 4),
                   5: ("end", 6), 6: ("reasoning", 3)}


def test_critic_gate(spark):
    rows = [(1, 0.5, 0.4, True, "ok"), (2, 0.7, -0.05, True, ""), (3, 0.5, 0.0, True, ""),
            (4, 0.95, 0.3, False, "weak")]
    df = spark.createDataFrame(rows, "case_id bigint, confidence double, critic_adjust double, "
                                     "critic_approve boolean, critic_reasons string")
    got = {r.case_id: (r.critic_approved, round(r.confidence, 6), r.critique)
           for r in C.critic_gate(df).collect()}
    assert got[1] == (True, 0.75, "ok")                      # +0.4 clipped to +0.25
    assert got[2] == (True, 0.65, "")
    assert got[3][0] is False and got[3][2].startswith("Confidence is too low")
    assert got[4] == (False, 1.0, "weak")                   # clipped to 1.0, critic said no


def test_claim_confidence(spark):
    df = spark.createDataFrame([(1, "[PROVEN] a [PROVEN] b [INFERRED] c"), (2, "nothing"),
                                (3, "[PROVEN] x [INFERRED] y [INFERRED] z [INFERRED] w [INFERRED] v "
                                    "[INFERRED] u [INFERRED] t [INFERRED] s")],
                               "case_id bigint, rca string")
    got = {r.case_id: r.claim_confidence for r in C.claim_confidence(df).collect()}
    assert got == {1: 0.67, 2: 0.0, 3: 0.12}                 # 1/8 rounds half to even


def test_keywords_dedupe_and_new(spark):
    df = spark.createDataFrame([(1, ["error", "Heap"], ["ERROR", "heap", " OOM ", "", "oom"])],
                               "case_id bigint, existing array<string>, suggested array<string>")
    k = C.keyword_union(df).first()
    assert list(k.generated) == ["ERROR", "Exception", "Executor lost", "OutOfMemoryError",
                                 "GC overhead", "Container exited", "heap", "OOM"]
    assert list(k.keywords)[:2] == ["error", "Heap"] and "OOM" in k.keywords
    new = C.keyword_new(df).first()
    assert "heap" not in new.new_keywords and "OOM" in new.new_keywords


def test_claims_and_causal_chain(spark):
    cases = spark.createDataFrame([(1, ["Executor_lost", "Disk_full"]), (2, [])],
                                  "case_id bigint, key_evidence array<string>")
    ev = spark.createDataFrame([(1, "Executor_lost", 3), (1, "ERROR", 9), (2, "WARN", 1)],
                               "case_id bigint, pattern string, count bigint")
    assert [r.key for r in C.claims_supported(cases, ev).collect()] == ["Executor_lost"]
    assert [r.key for r in C.claims_unsupported(cases, ev).collect()] == ["Disk_full"]
    chain = C.causal_chain(spark, ev, C.rules_table(spark))
    paths = {r.path for r in chain.where(F.col("case_id") == 1).collect()}
    assert "Executor_lost -> OutOfMemoryError -> Data_skew" in paths
    rep = {(r.case_id, r.pos): r.pattern for r in C.report_evidence(cases, ev).collect()}
    assert rep == {(1, 1): "Executor_lost", (2, 1): "WARN"}


def test_causal_chain_is_whole_for_long_and_cyclic_rules(spark):
    long = [(f"n{i}", f"n{i + 1}", "k") for i in range(9)]
    cycle = [("a", "b", "k"), ("b", "a", "k")]
    rules = spark.createDataFrame(long + cycle, "symptom string, cause string, keyword string")
    ev = spark.createDataFrame([(1, "n0", 1), (2, "a", 1), (3, "unknown", 1)], "case_id bigint, pattern string, count bigint")
    got = {(r.case_id, r.depth, r.cause) for r in C.causal_chain(spark, ev, rules).collect()}
    assert got == {(1, i, f"n{i}") for i in range(1, 10)} | {(2, 1, "b")}


def test_causal_chain_of_many_cases(spark):
    """The recursion runs over the rules only, so the number of cases has no limit."""
    ev = spark.range(400_000).selectExpr("id AS case_id", "'Executor_lost' AS pattern", "1L AS count")
    assert C.causal_chain(spark, ev, C.rules_table(spark)).count() == 400_000 * 6


def shortest(rules):
    """{(root, cause): (depth, path)}: breadth first; of several predecessors the first by name."""
    after = {}
    for a, b in rules:
        if a is not None and b is not None and a != b:
            after.setdefault(a, set()).add(b)
    out = {}
    for root in after:
        depth, via, front = {root: 0}, {}, [root]
        while front:
            nxt = {}
            for m in front:
                for b in after.get(m, ()):
                    if b not in depth:
                        nxt[b] = min(nxt.get(b, m), m)
            for b, m in nxt.items():
                depth[b], via[b] = depth[m] + 1, m
            front = list(nxt)
        for b in via:
            path, at = [b], b
            while at != root:
                at = via[at]
                path.append(at)
            out[root, b] = (depth[b], via[b], " -> ".join(reversed(path)))
    return out


def _closed(spark, rules):
    df = spark.createDataFrame([(a, b, "k") for a, b in rules], "symptom string, cause string, keyword string")
    rows = C.close_rules(df).collect()
    got = {(r.root, r.cause): (r.depth, r.via, r.path) for r in rows}
    assert len(got) == len(rows)
    return got


def test_rules_close_over_small_graphs(spark):
    import random
    rng = random.Random(2)
    graphs = [[], [("a", "a"), (None, "b"), ("b", None)], [("a", "b"), ("b", "a"), ("b", "c"), ("a", "d"), ("d", "c")]]
    graphs += [[(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] for n, m in ((6, 9), (12, 14), (20, 25))]
    for g in graphs:
        assert _closed(spark, g) == shortest(g)


def test_rules_close_over_a_line_and_a_dense_cycle(spark):
    line = [(f"n{i:03}", f"n{i + 1:03}") for i in range(500)]
    got = _closed(spark, line)
    assert len(got) == 500 * 501 // 2 and got["n000", "n500"][0] == 500
    assert got["n000", "n500"][2] == " -> ".join(f"n{i:03}" for i in range(501))
    dense = [(f"d{i}", f"d{j}") for i in range(200) for j in range(200) if (i * j + i) % 3 == 0 or j == (i + 1) % 200]
    assert _closed(spark, dense) == shortest(dense)


def test_a_dense_frontier_meets_the_rules_alone(spark):
    pairs = [(a, b, 1) for a in range(40) for b in range(40) if a != b and (a + b) % 4 == 0]
    pairs += [(a, b, 2) for a in range(40) for b in range(40) if (a + b) % 4]
    known = spark.createDataFrame(pairs, "root long, cause long, depth int")
    ahead = known.where("depth = 2").selectExpr("root", "cause AS mid")
    few, C._STEP_ROWS = C._STEP_ROWS, 100
    try:
        assert C._stride(ahead, known, 2) == 1               # not every pair behind the frontier
        line = spark.createDataFrame([(a, a + d, d) for a in range(9) for d in (1, 2, 3, 4)], known.schema)
        assert C._stride(line.where("depth = 4").selectExpr("root", "cause AS mid"), line, 4) == 4
        assert C._stride(line.where("depth = 9").selectExpr("root", "cause AS mid"), line, 4) == 0
    finally:
        C._STEP_ROWS = few


def _graphs(rng):
    yield []
    yield [("a", "b"), ("b", "a"), ("b", "c"), ("a", "d"), ("d", "c"), ("é", "a"), ("c", "\U0001f600"), ("￮", "é"), ("", "a"), ("c", "")]
    for n, m in ((6, 9), (14, 16), (30, 45), (40, 400)):
        yield [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]


def test_held_rules_and_joined_rules_give_the_same_rows(spark, monkeypatch):
    """Followed by tasks in small pieces, or joined in rounds where the rules are too many for a task."""
    import random
    for g in _graphs(random.Random(7)):
        want = shortest(g)
        monkeypatch.setattr(C, "_CELLS", 50)
        monkeypatch.setattr(C, "_PATH_BYTES", 40)
        assert _closed(spark, g) == want
    monkeypatch.setattr(C, "_HELD_BYTES", 0)
    assert _closed(spark, g) == want


def test_held_rules_are_closed_without_a_shuffle_of_pairs(spark):
    """300 components of 5 symptoms: the pairs are made by the tasks that hold the roots."""
    rules = spark.createDataFrame([(f"g{g:03} {a}", f"g{g:03} {b}") for g in range(300) for a in range(5) for b in range(5) if b == (a + 1) % 5],
                                  "symptom string, cause string")
    closed = C.close_rules(rules)
    assert closed.count() == 300 * 20 and closed.agg(F.max("depth")).first()[0] == 4
    plan = closed._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
