"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary file.

Texts of at most ``chunk`` code points are encoded as they are. A longer text is cut into
chunks that overlap by ``overlap`` code points and are dealt to tasks of their own:

1. each chunk is pre-tokenised, and gives the token starts that lie in its overlaps;
2. a chunk and the one before resynchronise at the first start that both have. The pattern
   never looks back, so from there on both split alike. A start counts only behind a
   character that is no white space and two characters from the chunk's end, as the end of
   a chunk can change its last tokens, and a cut behind white space those of a piece;
3. the pieces between those points are encoded, chunk by chunk;
4. the pieces' ids are put together in order, one text at a time.

A text in which some overlap has no common start (one token longer than the overlap) is
encoded whole. Equal long texts are encoded once. Decoding joins the tokens' bytes.

Defined cases: a null text is empty and has no ids. Repeated rows and ids, and null ids, give
a row each; only the text decides. The vocabulary is read by the driver from the path it is
given and broadcast (a file of fixed size, about 50,000 entries). Other columns pass through;
one named ``n_tokens`` or ``ids`` (``decoded`` when decoding) gives way to the result's.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, as_fields, record_batch, tidy



def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Pattern and ranks, as a broadcast; encoders are made once for each Python worker."""

    def __init__(self, spark, path: str, pattern: str):
        self.pattern, self.ranks = pattern, spark.sparkContext.broadcast(read_ranks(path))

    def encoder(self):
        return _encoder(self.pattern, self.ranks)


@lru_cache(maxsize=4)
def _encoder(pattern, ranks):
    import tiktoken
    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})


def encode_text(encoder, text: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(encoder.encode_ordinary(text), "<u4").tobytes()


# ------------------------------------------------------------- long texts --

def safe_starts(text: str, pattern, base: int, last: bool) -> list[int]:
    """Token starts of a chunk that begins at ``base``, at which it may be cut."""
    end = len(text) if last else len(text) - 2
    return [base + m.start() for m in pattern.finditer(text)
            if 0 < m.start() <= end and not text[m.start() - 1].isspace()]


def _chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    ddl = "text_key string, k int, last boolean, body string"
    schema = arrow_schema(as_fields(ddl))

    def run(batches):
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = -(-len(text) // chunk)
                for k in range(n):
                    yield record_batch({"text_key": [key], "k": [k], "last": [k == n - 1],
                                        "body": [text[k * chunk:(k + 1) * chunk + overlap]]}, schema)

    return long.select("text_key", "body").mapInArrow(tidy(run), ddl).dropDuplicates(["text_key", "k"])


def _boundaries(chunks: DataFrame, vocab: Vocabulary, chunk: int, overlap: int) -> DataFrame:
    ddl = "text_key string, k int, last boolean, head array<bigint>, tail array<bigint>"
    schema = arrow_schema(as_fields(ddl))
    source = vocab.pattern

    def run(batches):
        pattern = regex.compile(source)
        for b in batches:
            out = {f.name: [] for f in schema}
            for key, k, last, body in zip(*(c.to_pylist() for c in b.columns)):
                starts = safe_starts(body, pattern, k * chunk, last)
                out["text_key"].append(key)
                out["k"].append(k)
                out["last"].append(last)
                out["head"].append([s for s in starts if k and s < k * chunk + overlap])
                out["tail"].append([s for s in starts if s >= (k + 1) * chunk and not last])
            yield record_batch(out, schema)

    return chunks.mapInArrow(tidy(run), ddl)


def _pieces(bounds: DataFrame) -> DataFrame:
    """(text_key, k, start, stop): what of chunk k is encoded; start is null if the chunks don't meet."""
    w = Window.partitionBy("text_key").orderBy("k")
    start = (F.when(F.col("k") == 0, F.lit(0).cast("bigint"))
             .otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(w)))))
    met = bounds.select("text_key", "k", "last", start.alias("start"))
    return (met.withColumn("stop", F.lead("start").over(w))
            .withColumn("ok", F.min(F.col("start").isNotNull()).over(Window.partitionBy("text_key"))))


def _encode_long(long: DataFrame, vocab: Vocabulary, chunk: int, overlap: int) -> DataFrame:
    """(text_key, ids) for each distinct long text."""
    chunks = _chunks(long, chunk, overlap)
    pieces = _pieces(_boundaries(chunks, vocab, chunk, overlap))
    parts = chunks.select("text_key", "k", "body").join(pieces.filter("ok"), ["text_key", "k"])
    ddl = "text_key string, k int, part binary"
    schema = arrow_schema(as_fields(ddl))

    def encode(batches):
        enc = vocab.encoder()
        for b in batches:
            for key, k, body, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                base = k * chunk
                text = body[start - base:None if stop is None else stop - base]
                yield record_batch({"text_key": [key], "k": [k], "part": [encode_text(enc, text)]}, schema)

    ids = parts.select("text_key", "k", "body", "start", "stop").mapInArrow(tidy(encode), ddl)
    ids = ids.repartition("text_key").sortWithinPartitions("text_key", "k")
    ddl2 = "text_key string, ids binary"
    schema2 = arrow_schema(as_fields(ddl2))

    def joined(batches):
        key, got = None, []
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        yield record_batch({"text_key": [key], "ids": [b"".join(got)]}, schema2)
                    key, got = k, []
                got.append(part)
        if key is not None:
            yield record_batch({"text_key": [key], "ids": [b"".join(got)]}, schema2)

    stitched = ids.select("text_key", "part").mapInArrow(tidy(joined), ddl2)
    # Texts whose chunks don't meet are encoded whole.
    broken = pieces.filter("NOT ok").select("text_key").distinct()
    rest = long.select("text_key", "body").dropDuplicates(["text_key"]).join(broken, "text_key", "left_semi")

    def whole(batches):
        enc = vocab.encoder()
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield record_batch({"text_key": [key], "ids": [encode_text(enc, text)]}, schema2)

    return stitched.unionByName(rest.select("text_key", "body").mapInArrow(tidy(whole), ddl2))


# --------------------------------------------------------------- operator --

def _map_column(df: DataFrame, column: str, keep, fields, work) -> DataFrame:
    src = df.select(*dict.fromkeys([*keep, column]))
    out_fields = [src.schema[c] for c in keep] + fields
    schema = arrow_schema(out_fields)

    def run(batches):
        state = work()
        for b in batches:
            values = b.column(b.schema.get_field_index(column))
            step = 256                       # results go out in small batches
            for a in range(0, b.num_rows, step):
                got = state(values.slice(a, step).to_pylist())
                rows = b.slice(a, step)
                yield record_batch({**{c: rows.column(rows.schema.get_field_index(c)) for c in keep}, **got}, schema)

    return src.mapInArrow(tidy(run), T.StructType(out_fields))


def encoded(docs: DataFrame, vocab: Vocabulary, text: str = "text", keep=None, chunk: int = 1 << 16,
            overlap: int = 1 << 11) -> DataFrame:
    """``keep`` (all but clashing columns), n_tokens and ids (little-endian unsigned 32-bit integers)."""
    if not 0 < overlap < chunk:
        raise ValueError("overlap must be positive and less than chunk")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "ids")]
    is_long: Column = F.length(F.coalesce(F.col(text), F.lit(""))) > chunk
    src = docs.select(*dict.fromkeys([*keep, text]))

    def work():
        enc = vocab.encoder()
        return lambda texts: {"ids": [encode_text(enc, t or "") for t in texts]}

    short = _map_column(src.filter(~is_long), text, keep, as_fields("ids binary"), work)
    keyed = src.filter(is_long).withColumn("__text_key", F.sha2(F.col(text), 256))
    ids = _encode_long(keyed.select(F.col("__text_key").alias("text_key"), F.col(text).alias("body")), vocab, chunk, overlap)
    ids = ids.withColumnsRenamed({"text_key": "__of", "ids": "__ids"})
    long = (keyed.join(ids, F.col("__text_key") == F.col("__of"))
            .select(*keep, F.col("__ids").alias("ids")))
    out = short.unionByName(long)
    return out.select(*keep, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


def decoded(rows: DataFrame, vocab: Vocabulary, ids: str = "ids", keep=None) -> DataFrame:
    """``keep`` and decoded: the bytes of the ids' tokens, one after the other; null ids give no bytes."""
    keep = [c for c in (rows.columns if keep is None else keep) if c != "decoded"]

    def work():
        ranks = vocab.ranks.value
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            table[i] = token
        def join(values):
            return {"decoded": [b"".join(map(table.__getitem__, np.frombuffer(v or b"", "<u4").tolist())) for v in values]}
        return join

    return _map_column(rows, ids, keep, as_fields("decoded binary"), work)
