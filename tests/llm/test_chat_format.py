import random

from loglens.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, n string, k string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "x") for r in rows], SCHEMA).repartition(4)


def brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        if c is not None and t is not None:
            convs.setdefault(c, []).append((t, r or "", x or ""))
    whole = {c: tuple(v[1:] for v in sorted(t)) for c, t in convs.items()}
    out = {}
    for c, turns in whole.items():
        if not any(len(o) > len(turns) and o[:len(turns)] == turns for o in whole.values()):
            first, n = out.get(turns, (c, 0))
            out[turns] = (min(first, c), n + 1)
    return sorted((c, len(t), n, "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)) for t, (c, n) in out.items())


def test_equals_brute_force(spark):
    rnd = random.Random(2)
    rows, c = [], 0
    for _ in range(25):
        turns = [(rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "a longer text", "", None, "ü"])) for _ in range(rnd.randrange(1, 7))]
        for _ in range(rnd.randrange(1, 5)):
            shift = rnd.randrange(0, 3)
            rows += [(c, i * 2 + shift, *t) for i, t in enumerate(turns[:rnd.randrange(1, len(turns) + 1)])]
            c += 1
    rows += rows[:10]                                   # repeated rows
    rows += [(None, 0, "user", "x"), (5, None, "user", "x"), (900, 1, "user", "a"), (900, 1, "user", "b"), (901, 7, "user", "y" * 200_000)]
    got = sorted(tuple(r) for r in C.collapsed(frame(spark, rows)).select("conv_id", "n_turns", "n_copies", "text").collect())
    assert got == brute(rows)


def test_template_and_empty_table(spark):
    got = C.collapsed(frame(spark, [(1, 0, "user", "a"), (1, 1, "bot", "b")]), "[{role}] {text};").collect()
    assert [r.text for r in got] == ["[user] a;[bot] b;"]
    assert C.collapsed(frame(spark, [])).collect() == []
