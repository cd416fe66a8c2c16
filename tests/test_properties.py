"""Property checks with hypothesis: Spark expressions vs Python's re on
random lines (one Spark job per example batch, so examples are few)."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loglens.functions import patterns as P
from loglens.functions import text as T
from loglens.operators.search import grep

ALPHABET = "abcAB01 .:-()TIDexecutortask"
PATTERNS = [r"\d+", r"[ab]+c", r"task \d", r"(?:ex|ta)", r"\.\d", r"A|B", r"\(\w+\)"]

line_lists = st.lists(st.text(alphabet=ALPHABET, min_size=0, max_size=40), min_size=1, max_size=25)
SETTINGS = settings(max_examples=15, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(texts=line_lists, pats=st.lists(st.sampled_from(PATTERNS), min_size=1, max_size=3))
def test_grep_any_spans_equal_python(lines, texts, pats):
    rows = [("p", i, t) for i, t in enumerate(texts)]
    got = {r.line_no: [(s.start, s.end) for s in r.spans]
           for r in grep(lines(rows), pats, with_spans=True).collect()}
    rx = re.compile("|".join(f"(?:{p})" for p in pats))
    want = {i: [m.span() for m in rx.finditer(t)] for i, t in enumerate(texts) if rx.search(t)}
    assert got == want


@SETTINGS
@given(texts=line_lists)
def test_templates_equal_python(spark, texts):
    df = spark.createDataFrame([(i, "25/10/08 06:23:27 ERROR X: " + t) for i, t in enumerate(texts)],
                               "i int, line string")
    got = {r.i: (r.k, list(r.v)) for r in df.select(
        "i", T.error_pattern("line", strip_prefix=False).alias("k"),
        T.extract_variables("line").alias("v")).collect()}
    for i, t in enumerate(texts):
        line = "25/10/08 06:23:27 ERROR X: " + t
        msg = line.split(":", 1)[1].strip()
        found = []
        for rx, rep in P.NORMALIZE_RULES:
            msg = re.sub(rx, rep, msg, flags=re.IGNORECASE)
        for rx, _ in P.NORMALIZE_RULES:
            found += re.findall(rx, line, flags=re.IGNORECASE)
        assert got[i] == (msg, found)


@SETTINGS
@given(values=st.lists(st.tuples(st.integers(0, 5000), st.sampled_from(["", "K", "M", "G", "KB", "MB"]),
                                 st.sampled_from(["", ",", "."])), min_size=1, max_size=20))
def test_sizes_equal_python(spark, values):
    from pyspark.sql import functions as F
    from loglens.functions.gcparse import size_to_bytes
    texts = []
    for n, unit, sep in values:
        s = f"{n}"
        if sep and len(s) > 1:
            s = s[:1] + sep + s[1:]
        texts.append(s + unit)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = {r.i: r.b for r in df.select("i", size_to_bytes(F.col("s")).alias("b")).collect()}
    units = {"K": 1024, "M": 1024 ** 2, "G": 1024 ** 3, "T": 1024 ** 4}
    for i, t in enumerate(texts):
        s2 = t.strip().upper().replace(",", "")
        m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([KMGT])B?", s2)
        want = int(float(m.group(1)) * units[m.group(2)]) if m else (int(s2) if re.fullmatch(r"\d+", s2) else None)
        assert got[i] == want, t
