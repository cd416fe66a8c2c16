"""File scan options on small trees made with mktemp, JSON / text inputs."""

import io
import json
import os
import re
import tempfile

from hypothesis import assume, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loglens.sources import files as FS
from loglens.sources import json_text as J


def _tree():
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    os.makedirs(f"{root}/service=driver")
    os.makedirs(f"{root}/nested/deeper")
    os.makedirs(f"{root}/.hidden")
    with open(f"{root}/service=driver/driver.log", "w") as f:
        f.write("one\nERROR two\nthree\n")
    with open(f"{root}/nested/deeper/x.log", "wb") as f:
        f.write(b"a\r\nb ERROR\rc\n")                  # CR LF, lone CR, LF
    with open(f"{root}/.hidden/h.log", "w") as f:
        f.write("ERROR hidden\n")
    with open(f"{root}/top.log", "w") as f:
        f.write("ERROR top\n")
    with open(f"{root}/bin.dat", "wb") as f:
        f.write(b"ERROR\x00binary\n")
    return root


def test_recursive_scan_numbers_hidden_binary(spark):
    root = _tree()
    got = {(os.path.relpath(r.path.replace("file:", ""), root), r.line_no, r.line_text)
           for r in FS.scan_lines(spark, root).collect()}
    assert got == {("service=driver/driver.log", 1, "one"), ("service=driver/driver.log", 2, "ERROR two"),
                   ("service=driver/driver.log", 3, "three"), ("nested/deeper/x.log", 1, "a"),
                   ("nested/deeper/x.log", 2, "b ERROR"), ("nested/deeper/x.log", 3, "c"),
                   ("top.log", 1, "ERROR top")}
    with_bin = FS.scan_lines(spark, root, skip_binary=False)
    assert with_bin.where(F.col("path").endswith("bin.dat")).count() == 1


def test_non_recursive_size_cap_and_roots(spark):
    root = _tree()
    top = {os.path.basename(r.path) for r in FS.scan_lines(spark, root, recursive=False).collect()}
    assert top == {"top.log"}
    small = FS.scan_lines(spark, root, max_bytes_per_file=12).select("path").distinct().collect()
    assert {os.path.basename(r.path) for r in small} == {"top.log"}
    assert FS.scan_lines(spark, root, allowed_roots=["/Volumes/"]).count() == 0
    assert FS.scan_lines(spark, root + "/../x").count() == 0


def test_line_numbers_survive_file_splits(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{root}/big.log", "w") as f:
        for i in range(1, 20001):
            f.write(f"line {i}\n")
    df = FS.scan_lines(spark, root, block_bytes=16384)
    bad = df.where(F.col("line_text") != F.concat(F.lit("line "), F.col("line_no").cast("string")))
    assert df.count() == 20000 and bad.count() == 0
    assert df.rdd.getNumPartitions() > 8


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"\n", b"\r", b"\r\n", b"a", b"bc", b"\xe2", "é".encode(), b"\0"]), max_size=30), st.integers(1, 9), st.integers(1, 5))
def test_ranges_give_each_line_once(parts, block, chunk):
    """Any cut of a file into ranges, read in any chunks: the lines that Python's text mode gives, in order."""
    data = b"".join(parts)
    assume(not re.search(rb"\r\xe2+\n", data))       # line ends are found in the bytes, before invalid ones are dropped
    want = [x.rstrip("\n\r") for x in io.TextIOWrapper(io.BytesIO(data), encoding="utf-8", errors="ignore")]
    got, counted = [], 0
    for start in range(0, len(data), block):
        for piece in FS.segments(io.BytesIO(data), start, min(len(data), start + block), len(data), chunk):
            got += FS.lines_in(piece, "utf-8")
            counted += FS.count_in(piece)
    assert got == want
    invalid_end = bool(re.search(rb"(^|[\r\n])\xe2+\Z", data))     # \Z: "$" would also match in front of a last line end
    assert counted - len(want) == invalid_end


def test_scan_options(spark):
    root = _tree()
    os.makedirs(f"{root}/_under")
    with open(f"{root}/_under/_x.log", "wb") as f:
        f.write(b"caf\xc3\xa9 \xff\xe2\x82 end\r" + b"x" * 4096 + b"\0")
    open(f"{root}/empty.log", "w").close()
    read = lambda *a, **k: {(os.path.relpath(r.path, root), r.line_no, r.line_text[:9]) for r in FS.scan_lines(spark, *a, **k).collect()}
    under = {("_under/_x.log", 1, "café  end"), ("_under/_x.log", 2, "x" * 9)}
    assert under <= read(root) and not any(p.startswith((".", "bin")) for p, _, _ in read(root))
    assert (".hidden/h.log", 1, "ERROR hid") in read(root, include_hidden=True)
    assert read(root, skip_binary=False) - read(root) == {("bin.dat", 1, "ERROR\0bin")}
    assert ("_under/_x.log", 1, "cafÃ© ÿâ\x82") in read(root, encoding="latin-1")
    assert read(root, recursive=False) == read("file:" + root, recursive=False) == read("file://" + root + "/", recursive=False) == {("top.log", 1, "ERROR top")}
    assert read(root + "/top.log", recursive=False) == read("file:" + root + "/top.log") == {("top.log", 1, "ERROR top")}
    assert read(f"{root}/.hidden") == read(f"{root}/.hidden/h.log") == read(root + "/missing") == set()
    assert read(f"{root}/.hidden", include_hidden=True) != set()
    assert {p for p, _, _ in read(root, max_bytes_per_file=10)} == {"top.log", "nested/deeper/x.log"} - ({"nested/deeper/x.log"} if os.path.getsize(f"{root}/nested/deeper/x.log") > 10 else set())


def test_search_numbers_only_the_hits(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    lines = [f"{'hit' if i % 37 == 0 else 'no'} {i}" for i in range(1, 5001)]
    for name, sep in (("a.log", "\n"), ("b.log", "\r\n"), ("c.log", "\r")):
        with open(f"{root}/{name}", "w", newline="") as f:
            f.write(sep.join(lines))
    got = FS.search_files(spark, root, ["hit"], block_bytes=1000, with_spans=True)
    rows = got.collect()
    assert sorted((os.path.basename(r.path), r.line_no, r.line_text) for r in rows) == [
        (n, i, f"hit {i}") for n in ("a.log", "b.log", "c.log") for i in range(37, 5001, 37)]
    assert all([(s.start, s.end) for s in r.spans] == [(0, 3)] for r in rows)
    first = FS.search_files(spark, root, ["hit"], block_bytes=1000, limit=2).collect()
    assert [(os.path.basename(r.path), r.line_no) for r in first] == [("a.log", 37), ("a.log", 74)]
    assert FS.search_files(spark, root, ["nothing"], block_bytes=1000).collect() == []


def test_a_file_over_two_gibibytes(spark):
    """Sparse: NULs behind the text, so reading it whole would take what binary files take."""
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{root}/huge.log", "wb") as f:
        f.write(b"first line of text\n" * 300)
        f.seek((2 << 30) + (300 << 20))
        f.write(b"\nERROR far behind\n")
    with open(f"{root}/huge.bin", "wb") as f:
        f.write(b"\0")
        f.truncate(3 << 30)
    parts = FS.LogFilesReader({"target": root}).partitions()
    assert sum(len(p.ranges) for p in parts) == 37 + 48
    last = [r for p in parts for r in p.ranges if r[0].endswith("huge.log")][-1]
    reader = FS.LogFilesReader({"target": root})
    got = [t for b in reader.read(FS.Ranges([last])) for t in b["line_text"].to_pylist()]
    assert got == ["ERROR far behind"]
    assert list(reader.read(FS.Ranges([(f"{root}/huge.bin", 1 << 30, (1 << 30) + 5, 3 << 30)]))) == []


def test_json_hits_and_chatter(spark):
    arr = json.dumps([{"line_text": "ERROR a", "path": "/p", "line_no": 3}, 5,
                      {"line_text": "b", "path": None, "line_no": 4}])
    df = spark.createDataFrame([(1, arr), (2, "not json")], "id int, t string")
    got = [(r.path, r.line_no, r.line_text) for r in J.hits_from_json(df, "t").orderBy("item_no").collect()]
    assert ("/p", 3, "ERROR a") in got and (None, 4, "b") in got
    chatter = "Found 2 hits\n'" + arr + "'"
    df2 = spark.createDataFrame([(1, chatter), (2, "no array here")], "id int, t string")
    got2 = J.hits_from_blob(df2, "t", keep=["id"]).collect()
    assert {r.id for r in got2} == {1} and {r.line_text for r in got2} >= {"ERROR a", "b"}


def test_lines_from_blob_like_splitlines(spark):
    texts = ["a\nb\r\nc\rd\n", "", "x", "p\n\nq\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {}
    for r in J.lines_from_blob(df, "t", keep=["id"]).collect():
        got.setdefault(r.id, []).append((r.line_no, r.line_text))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == list(enumerate(t.splitlines(), start=1))


def test_user_context(spark):
    conv = spark.createDataFrame(
        [(1, 2, "user", "second"), (1, 1, "user", "first"), (1, 3, "assistant", "x"),
         (1, 4, "user", ""), (2, 1, "system", "s")], "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r.user_context for r in J.user_context(conv).collect()}
    assert got == {1: "first\n\nsecond", 2: ""}


def test_scan_of_paths_with_blanks_and_plus(spark, tmp_path):
    from loglens.sources.files import scan_lines
    root = tmp_path / "my logs+1"
    (root / "sub").mkdir(parents=True)
    (root / "a b.log").write_text("one\ntwo\n")
    (root / "bin.log").write_bytes(b"x\x00y\n")
    (root / "sub" / "c.log").write_text("three\n")
    got = scan_lines(spark, str(root)).collect()
    assert {(r.path.split("my logs+1")[-1], r.line_no, r.line_text) for r in got} == {
        ("/a b.log", 1, "one"), ("/a b.log", 2, "two"), ("/sub/c.log", 1, "three")}
    flat = scan_lines(spark, str(root), recursive=False).collect()
    assert {r.line_text for r in flat} == {"one", "two"}
    alone = scan_lines(spark, str(root / "a b.log"), recursive=False).collect()
    assert sorted(r.line_text for r in alone) == ["one", "two"]


def test_small_ranges_share_a_task(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for k in range(20):
        with open(f"{root}/{k:02}.log", "w") as f:
            f.write("".join(f"line {i} of {k}\n" for i in range(200)))
    parts = FS.LogFilesReader({"target": root, "blockBytes": 100, "tasks": 4}).partitions()
    assert len(parts) <= 5 and sum(len(p.ranges) for p in parts) > 400
    batches = [b for p in parts for b in FS.LogFilesReader({"target": root, "blockBytes": 100}).read(p)]
    assert len(batches) <= 5 and sum(b.num_rows for b in batches) == 4000
    got = FS.scan_lines(spark, root, block_bytes=100)
    assert got.where("line_text = concat('line ', line_no - 1, ' of ', cast(substring(path, -6, 2) as int))").count() == got.count() == 4000
    assert FS.chunk_for(0, 100) < 100_000                    # a range does not read megabytes behind it


def test_rows_of_a_task_do_not_grow_with_the_table(spark, monkeypatch, tmp_path):
    from loglens.sources import tables
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 10)
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    df = tables.table(spark, str(tmp_path), "events")
    assert df.rdd.getNumPartitions() == 100 and df.count() == 1000
