"""Line dedup: range-partitioned line hashes, streamed in order; keep bitmaps as the result.

1. A batch map cuts every text at ``\\n`` and gives (128-bit hash of the key, doc, positions)
   for each distinct key of at least ``min_chars`` code points in a document.
2. The rows are range-partitioned by (hash, doc), and sorted by hash, then document from the
   kept end, within each partition. The partitioning covers the document too, so a line that
   a third of all documents hold is dealt over many partitions.
3. Each partition is streamed: it holds back a key's first ``min_docs`` documents until the
   count decides, then passes rows on. A key that runs over a partition's edge is decided by
   a table of the partitions' first and last keys: two rows for each partition.
4. Dropped positions are gathered by document (never more than its own lines) into a
   compressed bitmap. Documents that lose nothing have no bitmap row.

Defined cases: a null or empty text is one empty line. A null doc id is an ordinary id that
sorts below all others. Rows with the same id and text are one holder, and all of them lose
the same lines; rows with the same id but other texts are one document for the count, each
with its own bitmap. Only the id and text columns are read; ``apply`` passes others on.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_fields, record_batch, stored, tidy

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_STRIP = " \t\n\x0b\x0c\r"
_OCC = "h1 bigint, h2 bigint, doc bigint, text_key bigint, n_lines int, positions binary"
_RUN = _OCC + ", part int, open_left boolean, open_right boolean, n_docs int, leads boolean"


def line_key(line: str) -> str:
    return line.strip(_STRIP).translate(_UPPER)


def with_key(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("body"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"))


def _occurrences(keyed: DataFrame, min_chars: int) -> DataFrame:
    schema = arrow_schema(as_fields(_OCC))

    def run(batches):
        for batch in batches:
            out, size = {f.name: [] for f in schema}, 0
            for doc, body, key in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
                                        for c in ("doc", "body", "text_key"))):
                lines = (body or "").split("\n")
                at: dict[str, list[int]] = {}
                for i, line in enumerate(lines):
                    if len(line) >= min_chars and len(k := line_key(line)) >= min_chars:
                        at.setdefault(k, []).append(i)
                for k, where in at.items():
                    h = xxhash.xxh3_128_intdigest(k.encode())
                    out["h1"].append((h >> 64) - (1 << 63))
                    out["h2"].append((h & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                    out["doc"].append(doc)
                    out["text_key"].append(key)
                    out["n_lines"].append(len(lines))
                    out["positions"].append(np.array(where, np.int32).tobytes())
                size += len(at)
                if size >= 50_000:
                    yield record_batch(out, schema)
                    out, size = {f.name: [] for f in schema}, 0
            yield record_batch(out, schema)

    return keyed.mapInArrow(tidy(run), _OCC)


def _streamed(ordered: DataFrame, min_docs: int) -> DataFrame:
    """Per partition: rows of keys known to reach ``min_docs``, and rows of keys open at an edge.

    A row's ``leads`` marks the key's first document in the partition; ``n_docs`` is how many
    documents of the key the partition holds (on its last row of a key that is open).
    """
    schema = arrow_schema(as_fields(_RUN))
    names = [f.name for f in schema][:6]

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        out = {f.name: [] for f in schema}
        held: list[tuple] = []           # rows of the key that are not decided yet
        key, n_docs, last_doc, lead_doc, first_run, limit = None, 0, (), None, True, 10_000

        def emit(row, leads, right=False, n=None):
            for c, v in zip(names, row):
                out[c].append(v)
            out["part"].append(part)
            out["open_left"].append(first_run)
            out["open_right"].append(right)
            out["n_docs"].append(n_docs if n is None else n)
            out["leads"].append(leads)

        def close(right):
            """The key ends here. An open key also gives its first document and number of documents, on a row without positions."""
            if key is None:
                return
            if first_run or right:
                for row, lead in held:
                    emit(row, lead, right)
                emit((*key, lead_doc, None, None, None), True, right, n_docs)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != key:
                    if key is not None:
                        close(False)
                        first_run = False
                    key, n_docs, last_doc = row[:2], 0, ()
                if (row[2],) != last_doc:
                    lead_doc = row[2] if n_docs == 0 else lead_doc
                    n_docs, last_doc = n_docs + 1, (row[2],)
                lead = n_docs == 1
                if n_docs < min_docs:
                    held.append((row, lead))
                    if len(held) > limit:            # one document's many repeated rows: they fare alike
                        held[:] = list(dict.fromkeys(held))
                        limit = max(10_000, 2 * len(held))
                else:
                    for r, was in held:
                        emit(r, was)
                    held.clear()
                    emit(row, lead)
                if len(out["h1"]) >= 20_000:
                    yield record_batch(out, schema)
                    out = {f.name: [] for f in schema}
        close(True)
        yield record_batch(out, schema)

    return ordered.mapInArrow(tidy(run), _RUN)


def keep_bitmaps(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 40,
                 min_docs: int = 5, keep: str = "last") -> DataFrame:
    """(doc, text_key, n_lines, keep_bits): zlib-compressed bits, one for each line, 1 = stays.

    A key found in ``min_docs`` documents or more stays in one only: the largest id
    (``keep="last"``) or the smallest (``"first"``).
    """
    occ = stored(_occurrences(with_key(docs, doc, text), min_chars))     # read twice: range bounds are sampled
    of_doc = F.col("doc").desc_nulls_last() if keep == "last" else F.col("doc").asc_nulls_last()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (occ.repartitionByRange(parts, "h1", "h2", of_doc, "text_key")
               .sortWithinPartitions("h1", "h2", of_doc, "text_key"))
    runs = stored(_streamed(ordered, min_docs))
    dropped = _decided(runs, min_docs)
    return _bitmaps(dropped)


def _decided(runs: DataFrame, min_docs: int) -> DataFrame:
    """Rows (doc, text_key, n_lines, positions) whose lines go."""
    lines = runs.filter("positions IS NOT NULL")
    # Not open to the left or right: rows here belong to keys that reached min_docs.
    inner = lines.filter("NOT open_left AND NOT open_right AND NOT leads")
    # Two rows for each partition: how many documents of its open keys it holds.
    ends = (runs.filter("positions IS NULL").groupBy("h1", "h2")
            .agg(F.sum("n_docs").alias("sum_docs"), F.min_by(F.struct("doc"), "part").alias("kept")))
    # A document lies on both sides of an edge only where its id repeats with other texts.
    docs_of = (lines.filter("open_left OR open_right").groupBy("h1", "h2", "doc")
               .agg(F.count_distinct("part").alias("k")).filter("k > 1")
               .groupBy("h1", "h2").agg(F.sum(F.col("k") - 1).alias("twice")))
    known = (ends.join(docs_of, ["h1", "h2"], "left")
             .filter(F.col("sum_docs") - F.coalesce("twice", F.lit(0)) >= min_docs)
             .select("h1", "h2", "kept"))
    edge = (lines.filter("open_left OR open_right").join(F.broadcast(known), ["h1", "h2"])
            .filter(~F.col("doc").eqNullSafe(F.col("kept.doc"))))
    cols = ["doc", "text_key", "n_lines", "positions"]
    return inner.select(*cols).unionByName(edge.select(*cols))


def _bitmaps(dropped: DataFrame) -> DataFrame:
    got = dropped.groupBy("doc", "text_key").agg(F.max("n_lines").alias("n_lines"),
                                                 F.collect_set("positions").alias("gone"))
    out = arrow_schema(as_fields("doc bigint, text_key bigint, n_lines int, keep_bits binary"))

    def run(batches):
        for b in batches:
            bits = []
            for n, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                keep = np.ones(n, np.uint8)
                for g in gone:
                    keep[np.frombuffer(g, np.int32)] = 0
                bits.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(bits, pa.binary())], schema=out)

    return got.mapInArrow(tidy(run), "doc bigint, text_key bigint, n_lines int, keep_bits binary")


def kept_lines(text: str | None, bits: bytes | None) -> tuple[int, int, str]:
    """(lines before, lines dropped, text of the lines that stay)."""
    text = text or ""
    if bits is None:
        return text.count("\n") + 1, 0, text
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[:len(lines)]
    stay = [x for x, k in zip(lines, keep.tolist()) if k]
    return len(lines), len(lines) - len(stay), "\n".join(stay)


def apply(docs: DataFrame, bitmaps: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' columns, the text without dropped lines, and n_lines, n_dropped.

    The bitmaps are joined by id and text hash. Their number grows with the corpus, so this is
    an ordinary join (one shuffle of the documents), which Spark may turn into a broadcast.
    """
    made = {"n_lines", "n_dropped"}
    cols = [c for c in docs.columns if c not in made]
    bits = bitmaps.select(F.col("doc").alias("__ld_doc"), F.col("text_key").alias("__ld_of"), F.col("keep_bits").alias("__ld_bits"))
    left = docs.select(*cols, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__ld_key"))
    joined = left.join(bits, F.col(doc).cast("bigint").eqNullSafe(F.col("__ld_doc")) & (F.col("__ld_key") == F.col("__ld_of")), "left")
    joined = joined.select(*cols, "__ld_bits")
    schema = [joined.schema[c] for c in cols] + as_fields("n_lines bigint, n_dropped bigint")
    from pyspark.sql import types as T
    arrow, at = arrow_schema(schema), cols.index(text)

    def run(batches):
        for b in batches:
            texts, bit_list = b.column(at).to_pylist(), b.column(len(cols)).to_pylist()
            n, gone, new = [], [], []
            for t, k in zip(texts, bit_list):
                a, d, s = kept_lines(t, k)
                n.append(a)
                gone.append(d)
                new.append(t if d == 0 else s)
            arrays = [b.column(i) for i in range(len(cols))]
            arrays[at] = pa.array(new, arrow.field(at).type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], schema=arrow)

    return joined.mapInArrow(tidy(run), T.StructType(schema))


def deduplicated(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 40,
                 min_docs: int = 5, keep: str = "last") -> DataFrame:
    return apply(docs, keep_bitmaps(docs, doc, text, min_chars, min_docs, keep), doc, text)
