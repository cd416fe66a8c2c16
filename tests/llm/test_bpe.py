import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from awkward import AWKWARD
from loglens.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TRICKY = ["a", "Z", "é", "😀", "'s", "'re", "'", " ", "  ", "\n", "\t", " ", "7", "٣", "!", "--", "字"]


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


def check(rows, got, plain):
    want = Counter((d, np.array(plain.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in rows)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)


def run(spark, df, **kw):
    vocab = B.Vocabulary(spark, PATH, public_tokenizers.PATTERN)
    return B.decoded(B.encoded(df, vocab, keep=["doc_id"], **kw), vocab).collect()


def test_round_trip_and_same_ids_whole(spark, docs, plain):
    rows = [(i, "Some text, it's <|endoftext|> 12 " * i) for i in range(9)] + AWKWARD
    check(rows, run(spark, docs(rows)), plain)


def test_chunks_stitch_to_the_same_ids(spark, docs, plain):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice(TRICKY) for _ in range(rnd.randrange(0, 900)))) for i in range(60)]
    rows += [(1, rows[1][1]), (None, rows[3][1])]
    rows += [(70, "ab cd " * 50 + "x" * 500 + " yz" * 50), (71, " " * 700), (72, "a b" + "\n" * 300 + "c d")]   # no common start
    for chunk, overlap in ((40, 13), (100, 60)):
        check(rows, run(spark, docs(rows), chunk=chunk, overlap=overlap), plain)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(TRICKY), max_size=60), st.integers(3, 25))
def test_safe_starts_are_token_starts_of_the_whole(parts, cut):
    """A chunk from the beginning finds only true starts, whatever follows it."""
    text, pattern = "".join(parts), regex.compile(public_tokenizers.PATTERN)
    true = {m.start() for m in pattern.finditer(text)} | {len(text)}
    assert set(B.safe_starts(text[:cut], pattern, 0, cut >= len(text))) <= true


def test_empty_table(spark, docs):
    assert run(spark, docs([])) == []
