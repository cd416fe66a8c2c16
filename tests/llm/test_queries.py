"""The registered queries on the small fixture: against their SQL, or the contract's values by plain code."""

import hashlib
import os
import zlib

import pytest

import __spark_entry__ as entry
import brute
from loglens.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_registered():
    names = set(entry.queries())
    assert set(Q.QUERIES) | {"pipeline"} <= names
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    res = duck.execute(Q.ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == sorted(map(tuple, res.fetchall()), key=repr)


def test_license_columns(spark, duck):
    from test_license_scan import base_hits, fuzzy_labels
    got = {r.doc_id: r for r in Q.op1_license_scan(spark, SF).collect()}
    for d, t in duck.execute("select doc_id, text from documents").fetchall():
        n, hits = base_hits(t)
        base = {x for _, x in hits}
        at = [i for i, _ in hits]
        r = got.pop(d)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(hits), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | fuzzy_labels(t)))
    assert not got


def test_bpe_columns(spark, duck):
    import numpy as np
    import public_tokenizers
    import tiktoken
    from loglens.llm.bpe import read_ranks
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    got = {r.doc_id: tuple(r)[1:] for r in Q.op8_byte_bpe(spark, SF).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for d, t in duck.execute("select doc_id, text from documents").fetchall():
        ids = enc.encode_ordinary(t or "")
        assert got[d] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode()))


def test_simhash_columns(spark, duck):
    from test_simhash import brute
    rows = duck.execute("select doc_id, text from documents").fetchall()
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in Q.op11_simhash_dedup(spark, SF).collect())
    assert got == sorted(brute(rows))


def test_language_held_out_accuracy(spark, duck):
    lang = dict(duck.execute("select doc_id, lang from documents").fetchall())
    rows = Q.op6_language_id(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_pipeline_equals_plain_code(spark, duck):
    """Language by the operator (its own tests check it); every other stage by plain code."""
    import numpy as np
    import public_tokenizers
    import tiktoken
    from loglens.llm import language_id
    from loglens.llm.bpe import read_ranks
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.filter(~language_id.is_held_out("doc_id")))
    rows = duck.execute("select doc_id, text from documents").fetchall()
    label = language_id.label_texts([t for _, t in rows], model)
    rows = [r for r, p, s in zip(rows, label["lang_pred"], label["score"]) if p != "und" and s >= 0.5]
    rows = [(d, t) for d, _, gone, t in brute.line_dedup(rows) if gone == 0 or t.strip()]
    comp, _ = brute.jaccard_components(rows)
    rows = [(d, t) for d, t in rows if comp[d] == d]
    items = duck.execute("select item_id, text from benchmark").fetchall()
    rows = [r for r, (_, _, hit, _) in zip(rows, brute.decontaminate(rows, items)) if hit == 0]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    want = sorted((d, t, np.array(enc.encode_ordinary(t), "<u4").tobytes()) for d, t in rows)
    got = entry.queries()["pipeline"](spark, SF).collect()
    assert sorted((r.doc_id, r.text, bytes(r.ids)) for r in got) == want
    assert all(r.lossless and r.n_chars == len(r.text) for r in got)
