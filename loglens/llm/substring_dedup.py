"""Substring dedup: runs of consecutive sentences that stand somewhere before are removed.

1. A text is cut into sentences: behind ``.``, ``!``, ``?``, ``;`` or ``:`` that white space follows, behind other
   scripts' full stops (``STOPS``, closing marks included), and at ``\\n``. A long sentence is cut at its
   clauses: behind a comma, once a clause has ``CLAUSE`` words; and what is then still longer than ``OVERLONG`` words behind
   words that their hash chooses, so that equal passages without a stop are cut alike wherever they
   stand. A sentence's key is its words in lower case (A-Z); those without a word are skipped.
2. From every sentence the shortest run of consecutive sentences that holds ``min_words`` words is hashed
   (128 bits), and the one that ends with the text; a text with fewer words is one run. Characters
   of scripts without blanks count as words. Within a text each hash is taken once, at its first place;
   later places of it are removals already.
3. Runs are joined globally without a join: they are written, range-partitioned by (hash, id, text) and sorted, and each
   partition is streamed. A place that differs from the first of its hash is a removal. Whether a
   partition's first hash began in the one before is decided by a table of the partitions' first and
   last hashes, a row each. The ranges cover the document, so a run that a third of all documents
   hold is dealt over many partitions.
4. Removed runs are gathered by document and joined to the documents by id and text hash; every sentence in one goes. Their number
   grows with the corpus, so this is an ordinary join (one shuffle of the documents).

The first place of a hash, by (id, text hash, position), stays.

Defined cases: a null or empty text has no sentences and stays as it is. Null ids come before all others.
Rows with the same id and text are one holder and fare alike; rows with one id and other texts are
told apart by the text's hash, in whose order they come. Of the documents' columns only the id and text
are read by the search; ``apply`` passes all on, but for ``n_sentences`` and ``n_removed``, which it makes.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, as_fields, record_batch, stored, tidy

#: Full stops behind which no white space need stand: CJK, Devanagari, Arabic, Ethiopic, Armenian, Khmer, Burmese.
STOPS = "\u3002\uff01\uff1f\uff61\u0964\u0965\u061f\u06d4\u1362\u1367\u0589\u17d4\u17d5\u104b"
_CLOSING = "\u300d\u300f\uff09\u3011\u300b\u201d\u2019\u00bb)\"'"
_ASCII_END = re.compile(r"(?<=[.!?;:])(?=\s)|(?<=\n)")
_END = re.compile(rf"(?<=[.!?;:])(?=\s)|(?<=\n)|(?<=[{STOPS}])(?![{STOPS}{_CLOSING}.!?])|(?<=[{STOPS}][{_CLOSING}])(?![{STOPS}{_CLOSING}.!?])")
_COMMA = re.compile(r"(?<=,)(?=\s)")
_WORD = re.compile(r"\S+\s*")
#: Characters that are a word each: scripts without blanks between words (Thai, Lao, Burmese, Khmer, kana, Han).
_UNSPACED = re.compile("[\u0e01-\u0e30\u0e81-\u0eb0\u1000-\u102a\u1780-\u17b3\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Words that a clause has at least, and that a sentence has at most before it is cut behind chosen words.
CLAUSE, OVERLONG = 8, 24
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256))


def pieces(text: str | None) -> list[str]:
    """The text cut behind each sentence; joined they are the text."""
    text, out = text or "", []
    for p in (_ASCII_END if text.isascii() else _END).split(text):
        if p.count(" ") + p.count("\t") < 2 * CLAUSE:
            if p:
                out.append(p)
            continue
        held = ""
        for clause in _COMMA.split(p):
            held += clause
            if len(held.split()) >= CLAUSE:
                out += _shorter(held)
                held = ""
        if held:
            out += _shorter(held)
    return out


def _shorter(clause: str) -> list[str]:
    """A clause of over ``OVERLONG`` words cut behind each word (letters in lower case) whose hash is a multiple of eight."""
    if len(clause.split()) <= OVERLONG:
        return [clause]
    out, held = [], ""
    for w in _led(clause):
        held += w
        if zlib.crc32(w.strip().encode("utf-8", "replace").translate(_TABLE)) % 8 == 0:
            out.append(held)
            held = ""
    return out + [held] if held else out


def _led(clause: str) -> list[str]:
    """Words with the white space behind them; that in front of the first goes with it."""
    lead = len(clause) - len(clause.lstrip())
    got = _WORD.findall(clause[lead:])
    return [clause[:lead] + got[0], *got[1:]] if got else [clause]


def sentence_keys(parts: list[str]) -> list[bytes]:
    """Normalised words of each piece (empty: not a sentence)."""
    return [b" ".join(p.encode().translate(_TABLE).split()) for p in parts]


def _n_words(key: bytes) -> int:
    n = key.count(b" ") + 1
    return n if key.isascii() else max(n, len(_UNSPACED.findall(key.decode("utf-8", "replace"))))


def spans_of(n_words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first sentence, end) of every run that is hashed, given the sentences' words."""
    upto, n = [0, *itertools.accumulate(n_words)], len(n_words)
    if not n or upto[-1] < min_words:
        return [(0, n)] if n else []
    ends = (bisect.bisect_left(upto, upto[a] + min_words) for a in range(n))
    spans = [(a, e) for a, e in enumerate(ends) if e <= n]
    tail = (bisect.bisect_right(upto, upto[n] - min_words) - 1, n)
    return spans if tail in spans[-1:] else [*spans, tail]


def runs_of(keys: list[bytes], min_words: int) -> list[tuple[int, int, bytes]]:
    """(index of the first sentence among sentences, number of sentences, 128-bit hash) of every run."""
    said = [k for k in keys if k]
    spans = spans_of([_n_words(k) for k in said], min_words)
    return [(a, b - a, xxhash.xxh3_128_digest(b"\n".join(said[a:b]))) for a, b in spans]


_RUNS = "h1 bigint, h2 bigint, doc bigint, text_key bigint, pos int, n int"


def _runs(docs: DataFrame, doc: str, text: str, min_words: int) -> DataFrame:
    """Each text's runs, a hash once; the later places of a hash in its own text without hash."""
    schema = arrow_schema(as_fields(_RUNS))

    def work(batches):
        for b in batches:
            ids, texts, keys = (c.to_pylist() for c in b.columns)
            for a in range(0, len(ids), 512):
                digests, at, size, d, k, again = [], [], [], [], [], []
                for i in range(a, min(len(ids), a + 512)):
                    seen = set()
                    for p, n, h in runs_of(sentence_keys(pieces(texts[i])), min_words):
                        again.append(h in seen)
                        seen.add(h)
                        digests.append(h)
                        at.append(p)
                        size.append(n)
                    d += [ids[i]] * (len(at) - len(d))
                    k += [keys[i]] * (len(at) - len(k))
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield record_batch({"h1": pa.array(h[:, 0], mask=np.array(again, bool)), "h2": pa.array(h[:, 1], mask=np.array(again, bool)),
                                    "doc": d, "text_key": k, "pos": at, "n": size}, schema)

    keyed = docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("body"),
                        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"))
    return keyed.mapInArrow(tidy(work), _RUNS)


_SEEN = "kind int, part int, h1 bigint, h2 bigint, l1 bigint, l2 bigint, doc bigint, text_key bigint, pos int, n int"
_LATER, _OPEN, _EDGE = 0, 1, 2


def _streamed(ordered: DataFrame) -> DataFrame:
    """Of each partition: places behind the first of their hash, places that are the first of the partition's
    first hash (open: it may have begun before), and a row with its first hash and its last."""
    schema = arrow_schema(as_fields(_SEEN))

    def work(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        first_key, key, place = None, None, None     # of the partition; of the row before and the first of its hash
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            h1, h2, tk, pos, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4, 5))
            null = b.column(2).is_null().to_numpy(zero_copy_only=False)
            doc = b.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            starts = np.ones(m, bool)
            starts[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            goes_on = key == (h1[0], h2[0])
            if first_key is None:
                first_key = (h1[0], h2[0])
            begin = np.maximum.accumulate(np.where(starts, np.arange(m), 0))
            f_null, f_doc, f_tk = null[begin], doc[begin], tk[begin]
            if goes_on:
                of = begin == 0
                f_null, f_doc, f_tk = np.where(of, place[0], f_null), np.where(of, place[1], f_doc), np.where(of, place[2], f_tk)
            later = (null != f_null) | (doc != f_doc) | (tk != f_tk)
            opens = ~later & (h1 == first_key[0]) & (h2 == first_key[1])
            some = np.flatnonzero(later | opens)
            key, place = (h1[-1], h2[-1]), (f_null[-1], f_doc[-1], f_tk[-1])
            none = pa.nulls(len(some), pa.int64())
            yield record_batch({"kind": np.where(later[some], _LATER, _OPEN).astype(np.int32), "part": np.full(len(some), part, np.int32),
                                "h1": none, "h2": none, "l1": none, "l2": none, "doc": pa.array(doc[some], mask=null[some]),
                                "text_key": tk[some], "pos": pos[some], "n": n[some]}, schema)
        if first_key is not None:
            yield record_batch({"kind": [_EDGE], "part": [part], "h1": [first_key[0]], "h2": [first_key[1]], "l1": [key[0]], "l2": [key[1]],
                                "doc": [None], "text_key": [None], "pos": [None], "n": [None]}, schema)

    return ordered.mapInArrow(tidy(work), _SEEN)


def repeated_runs(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = 25) -> DataFrame:
    """(doc, text_key, runs): first sentences and lengths of the runs that stand somewhere before."""
    rows = stored(_runs(docs, doc, text, min_words))             # read twice: range bounds are sampled
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("h1", "h2", F.col("doc").asc_nulls_first(), "text_key")
    seen = stored(_streamed(rows.where("h1 IS NOT NULL").repartitionByRange(parts, *order).sortWithinPartitions(*order)))
    before = Window.orderBy("part")                              # a row for each partition
    goes_on = (seen.where(F.col("kind") == _EDGE).withColumns({"p1": F.lag("l1").over(before), "p2": F.lag("l2").over(before)})
               .where("h1 = p1 AND h2 = p2").select("part"))
    place = ["doc", "text_key", "pos", "n"]
    later = (seen.where(F.col("kind") == _LATER).select(place)
             .unionByName(seen.where(F.col("kind") == _OPEN).join(F.broadcast(goes_on), "part").select(place))
             .unionByName(rows.where("h1 IS NULL").select(place)))
    return later.groupBy("doc", "text_key").agg(F.collect_set(F.struct("pos", "n")).alias("runs"))


def without_runs(text: str | None, runs: list[dict] | None) -> tuple[int, int, str | None]:
    """(sentences, sentences removed, text left)."""
    parts = pieces(text)
    keys = sentence_keys(parts)
    n = sum(1 for k in keys if k)
    if not runs:
        return n, 0, text
    gone = {r["pos"] + j for r in runs for j in range(r["n"])}
    out, i = [], -1
    for p, k in zip(parts, keys):
        i += bool(k)
        if not (k and i in gone):
            out.append(p)
    return n, len(gone), "".join(out)


def apply(docs: DataFrame, repeated: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    made = {"n_sentences", "n_removed"}
    cols = [c for c in docs.columns if c not in made]
    far = repeated.select(F.col("doc").alias("__ss_doc"), F.col("text_key").alias("__ss_of"), F.col("runs").alias("__ss_runs"))
    left = docs.select(*cols, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__ss_key"))
    on = F.col(doc).cast("bigint").eqNullSafe(F.col("__ss_doc")) & (F.col("__ss_key") == F.col("__ss_of"))
    joined = left.join(far, on, "left").select(*cols, "__ss_runs")
    fields = [joined.schema[c] for c in cols] + as_fields("n_sentences bigint, n_removed bigint")
    schema, at = arrow_schema(fields), cols.index(text)

    def work(batches):
        for b in batches:
            got = [without_runs(t, r) for t, r in zip(b.column(at).to_pylist(), b.column(len(cols)).to_pylist())]
            arrays = [b.column(i) for i in range(len(cols))]
            arrays[at] = pa.array([g[2] for g in got], schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([g[0] for g in got], pa.int64()),
                                              pa.array([g[1] for g in got], pa.int64())], schema=schema)

    return joined.mapInArrow(tidy(work), T.StructType(fields))


def deduplicated(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = 25) -> DataFrame:
    return apply(docs, repeated_runs(docs, doc, text, min_words), doc, text)
