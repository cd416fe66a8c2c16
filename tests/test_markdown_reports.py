"""Markdown typing (fences, headers, lists) and report formatting."""

from loglens.functions import markdown as M


def test_blocks_and_inline(spark):
    text = ["# Title", "para **bold** and *it* and `code` & <x>", "- item one", "* item two",
            "", "```", "# not a header", "```", "## Sub", "- new list"]
    df = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(text)],
                               "doc_id bigint, line_no bigint, line_text string")
    got = {r.line_no: (r.block_type, r.text, r.list_id) for r in M.blocks(df).collect()}
    assert got[1] == ("h1", "Title", None)
    assert got[2][0] == "paragraph" and got[2][1] == (
        'para <b>bold</b> and <i>it</i> and <font face="Courier" color="#E74C3C">code</font>'
        ' &amp; &lt;x&gt;')
    assert got[3][0] == got[4][0] == "list_item" and got[3][2] == got[4][2]
    assert got[5][0] == "blank" and got[6][0] == "fence" and got[7] == ("code", "# not a header", None)
    assert got[9][:2] == ("h2", "Sub") and got[10][2] != got[3][2]


def _plain(lines):
    """Block types and list numbers by one loop over a document's lines."""
    out, code, ends = [], False, 0
    for t in lines:
        s = t.strip()
        if s.startswith("```"):
            code, kind = not code, "fence"
        elif code:
            kind = "code"
        elif t.startswith(("# ", "## ", "### ")):
            kind = "h" + str(t.index(" "))
        elif s.startswith(("- ", "* ")):
            kind = "list_item"
        else:
            kind = "paragraph" if s else "blank"
            ends += 1
        out.append((kind, ends if kind == "list_item" else None))
    return out


def test_blocks_of_documents_over_many_slices(spark):
    import random
    rng = random.Random(6)
    docs = {f"d{k}": [rng.choice(["# h", "- a", "* b", "text", "", "```", "``` x", "### c", " - in"]) for _ in range(n)]
            for k, n in enumerate([400, 3, 1, 250, 60, 2, 2, 900])}
    rows = [(d, i + 1, t, "clash") for d, lines in docs.items() for i, t in enumerate(lines)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id string, line_no bigint, line_text string, f string").repartition(5)
    want = {(d, i + 1): x for d, lines in docs.items() for i, x in enumerate(_plain(lines))}
    for slices in (1, 7, 40):
        got = M.blocks(df, slices=slices)
        assert got.columns == ["doc_id", "line_no", "line_text", "f", "block_type", "text", "list_id"]
        assert {(r.doc_id, r.line_no): (r.block_type, r.list_id) for r in got.collect()} == want
