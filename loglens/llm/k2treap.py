"""Ranked lexical search over a K2-treap: a quadtree over the term-document grid with impact maxima.

A shard is a grid: a row for each of its terms, the most frequent first, a column for each of its documents
in the order of their ids; a point's value is the term's impact in the document. The quadtree
halves rows and columns; a node keeps four bits that say which quarters hold points, and its
largest impact as the difference to its parent's. Cells of ``2**LEAF`` rows and columns are leaves, whose points are
listed. Levels are arrays in Morton order, so a child's place is its first sibling's plus the
bits set before it.

1. One pass counts the documents' terms (N, L). A second builds the shards: a task packs its
   documents into grids of about ``POINTS`` points, without a shuffle, and writes them.
2. For a block of items: document frequencies from the shards' dictionaries, then weights.
3. In each shard an item's rows descend together: a range of columns holds a node for each row, its
   bound is the weighted sum of their maxima. Ranges wait in a queue; the best are halved (or, at
   the leaves, scored exactly from the points), those whose bound is under the item's 50th best
   score so far are left. A few shards go first; the scores they reach hold for all others.
4. The shards' lists, 50 rows for an item at most, are merged by score and id.

Statistics are global, so the merged lists are exact. Terms are told apart by 64-bit hashes.
Items are worked off in blocks of about ``BLOCK`` terms, each broadcast; a block reads the
index once.

Defined cases: null and empty texts have no terms and are never returned. Rows with the same id
and text are ranked each; rows with a null id come after equal scores. Items that share an id
(a null id too) are one item with the terms of all. An item without a term in the corpus has no rows.
Only ids and texts are read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_schema, as_fields, map_texts, record_batch, slices, stored, text_buffers, tidy
from .textbytes import ALNUM, words

LEAF = 5
POINTS = 1 << 21
BLOCK = 1 << 17
AT_ONCE = 64
_BITS = np.array([bin(i).count("1") for i in range(16)], np.int64)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of x moved to the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def morton(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    return (_spread(row) << np.uint64(1)) | _spread(col)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of a term's score that does not depend on its weight; 64-bit integers."""
    m = 50 + (50 * n.astype(np.int64) * n_docs) // n_terms
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m)


class Treap:
    """A quadtree over points (row, col, value > 0) of one grid."""

    def __init__(self, depth, bitmaps, maxima, level_at, keys, values):
        self.depth, self.level_at = depth, level_at          # levels from the root (0) to the leaves (depth)
        self.bitmap, self.max = bitmaps, maxima               # all levels, one after the other; leaves have no bitmap
        inner = int(level_at[depth])
        self.first = 1 + np.concatenate([[0], np.cumsum(_BITS[bitmaps[:inner]])[:-1]]) if inner else np.zeros(0, np.int64)
        self.keys, self.values = keys, values                # Morton of the leaf, then row and column within it

    @classmethod
    def build(cls, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> "Treap":
        side = int(max(row.max(), col.max())) + 1 if len(row) else 1
        depth = max(0, (side - 1).bit_length() - LEAF)
        low = np.uint64((1 << LEAF) - 1)
        r, c = row.astype(np.uint64), col.astype(np.uint64)
        keys = (morton(r >> np.uint64(LEAF), c >> np.uint64(LEAF)) << np.uint64(2 * LEAF)) | ((r & low) << np.uint64(LEAF)) | (c & low)
        order = np.argsort(keys)
        keys, values = keys[order], value[order].astype(np.int64)
        codes, at = np.unique(keys >> np.uint64(2 * LEAF), return_index=True)
        level = [(np.zeros(len(codes), np.uint8), np.maximum.reduceat(values, at) if len(at) else np.zeros(0, np.int64))]
        for _ in range(depth):
            up, at = np.unique(codes >> np.uint64(2), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint8(1) << (codes & np.uint64(3)).astype(np.uint8), at)
            level.append((bits, np.maximum.reduceat(level[-1][1], at)))
            codes = up
        level.reverse()
        level_at = np.concatenate([[0], np.cumsum([len(b) for b, _ in level])])
        return cls(depth, np.concatenate([b for b, _ in level]), np.concatenate([m for _, m in level]), level_at, keys, values)

    # Stored form: bitmaps of the inner nodes, maxima as differences, keys as differences.

    def packed(self) -> dict:
        diff = self.max.copy()
        inner = int(self.level_at[self.depth])
        parent = np.repeat(np.arange(inner), _BITS[self.bitmap[:inner]])
        diff[1:] = self.max[parent] - self.max[1:] if len(diff) > 1 else 0
        steps = np.diff(self.keys, prepend=np.uint64(0))
        return {"depth": self.depth, "level_at": self.level_at.astype("<i8").tobytes(), "bitmaps": _zip(self.bitmap[:inner].tobytes()),
                "maxima": _zip(diff.astype("<u4").tobytes()), "steps": _zip(steps.astype("<u8").tobytes()),
                "point_values": _zip(self.values.astype("<u4").tobytes())}

    @classmethod
    def unpacked(cls, t: dict) -> "Treap":
        level_at = np.frombuffer(t["level_at"], "<i8")
        depth, inner, n = t["depth"], int(level_at[t["depth"]]), int(level_at[-1])
        bitmap = np.concatenate([np.frombuffer(_unzip(t["bitmaps"]), np.uint8), np.zeros(n - inner, np.uint8)])
        maxima = np.frombuffer(_unzip(t["maxima"]), "<u4").astype(np.int64)
        tree = cls(depth, bitmap, maxima, level_at, np.cumsum(np.frombuffer(_unzip(t["steps"]), "<u8"), dtype=np.uint64),
                   np.frombuffer(_unzip(t["point_values"]), "<u4").astype(np.int64))
        for k in range(depth):                       # a child's maximum is its parent's less the difference
            a, b, c = level_at[k:k + 3]
            maxima[b:c] = np.repeat(maxima[a:b], _BITS[bitmap[a:b]]) - maxima[b:c]
        return tree

    def halved(self, node: np.ndarray, row_bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of inner nodes (-1: none) on the row's side, for the lower and the upper half of the columns."""
        there = node >= 0
        at = np.where(there, node, 0)
        bits, first = self.bitmap[at].astype(np.int64), self.first[at]
        out = []
        for half in (0, 1):
            digit = 2 * row_bit + half
            has = there & ((bits >> digit) & 1 > 0)
            out.append(np.where(has, first + _BITS[bits & ((1 << digit) - 1)], -1))
        return out[0], out[1]

    def bound(self, node: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return (np.where(node >= 0, self.max[np.maximum(node, 0)], 0) * weight).sum(-1)

    def scored(self, code_col: np.ndarray, rows: np.ndarray, node: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores over 0) of leaf ranges ``code_col`` (column of the leaf), exactly."""
        i, t = np.nonzero(node >= 0)
        r = rows[t].astype(np.uint64)
        lo = (morton(r >> np.uint64(LEAF), code_col[i]) << np.uint64(2 * LEAF)) | ((r & np.uint64((1 << LEAF) - 1)) << np.uint64(LEAF))
        a, b = np.searchsorted(self.keys, lo), np.searchsorted(self.keys, lo + np.uint64(1 << LEAF))
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        place = (np.repeat(i, n) << LEAF) + (self.keys[at] & np.uint64((1 << LEAF) - 1)).astype(np.int64)
        total = np.zeros(len(code_col) << LEAF, np.int64)
        np.add.at(total, place, self.values[at] * np.repeat(weight[t], n))
        got = np.flatnonzero(total > 0)
        return (code_col[got >> LEAF].astype(np.int64) << LEAF) + (got & ((1 << LEAF) - 1)), total[got]

    def best(self, rows: np.ndarray, weight: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of the k best columns with score ``floor`` or more; equal scores by column."""
        cols, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), max(1, floor)
        if not len(rows) or not len(self.values):
            return cols, scores
        rows, weight = rows.astype(np.int64), weight.astype(np.int64)
        root = np.zeros((1, len(rows)), np.int64)
        # The queue holds groups of ranges of one level, by the best bound of the group.
        queue, tie = [(-int(self.bound(root, weight)[0]), 0, 0, np.zeros(1, np.int64), root, self.bound(root, weight))], 0
        while queue and -queue[0][0] >= least:
            _, _, level, col, node, bound = heapq.heappop(queue)
            stay = bound >= least
            col, node, bound = col[stay], node[stay], bound[stay]
            if len(col) > AT_ONCE:                   # the best of them now, the rest later
                order = np.argsort(-bound, kind="stable")
                late = order[AT_ONCE:]
                tie += 1
                heapq.heappush(queue, (-int(bound[late[0]]), tie, level, col[late], node[late], bound[late]))
                col, node = col[order[:AT_ONCE]], node[order[:AT_ONCE]]
            if level == self.depth:
                c, s = self.scored(col.astype(np.uint64), rows, node, weight)
                ok = s >= least
                cols, scores = np.concatenate([cols, c[ok]]), np.concatenate([scores, s[ok]])
                if len(cols) > k:
                    top = np.lexsort((cols, -scores))[:k]
                    cols, scores = cols[top], scores[top]
                if len(cols) == k:
                    least = max(least, int(scores.min()))
                continue
            bit = (rows >> (LEAF + self.depth - 1 - level)) & 1
            lower, upper = self.halved(node, bit[None])
            node, col = np.concatenate([lower, upper]), np.concatenate([2 * col, 2 * col + 1])
            bound = self.bound(node, weight)
            ok = bound >= least
            if ok.any():
                tie += 1
                heapq.heappush(queue, (-int(bound[ok].max()), tie, level + 1, col[ok], node[ok], bound[ok]))
        top = np.lexsort((cols, -scores))
        return cols[top], scores[top]


def _zip(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


# ------------------------------------------------------------------ index --

def statistics(docs: DataFrame, text: str) -> tuple[int, int]:
    """(documents with a term, terms with repeats) of the whole table."""
    def make():
        return lambda data, offs, rows: {"n": words(data, offs, ALNUM).counts}
    got = map_texts(docs, text, make, "n bigint").agg(F.count_if(F.expr("n > 0")).alias("d"), F.sum("n").alias("t")).first()
    return got["d"], got["t"] or 0


def term_counts(data, offs) -> tuple[np.ndarray, ...]:
    """(row, term hash, occurrences) of a slice's distinct terms by row, and the rows' numbers of terms."""
    w = words(data, offs, ALNUM)
    row, h = w.rows(), w.hashes()
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    return row[new], h[new], np.diff(np.concatenate([new, [len(h)]])), w.counts


_SHARD = ("part int, seq int, docs binary, n_null int, terms binary, dfs binary, depth int, level_at binary, "
          "bitmaps binary, maxima binary, steps binary, point_values binary")


def _shard(ids: np.ndarray, null: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> dict:
    """One row of the index; ``doc`` are places in ``ids``."""
    order = np.lexsort((ids, null))                  # by id, null ids last
    column = np.empty(len(ids), np.int64)
    column[order] = np.arange(len(ids))
    terms, inverse, df = np.unique(term, return_inverse=True, return_counts=True)
    row_of = np.empty(len(terms), np.int64)
    row_of[np.lexsort((terms, -df))] = np.arange(len(terms))
    tree = Treap.build(row_of[inverse], column[doc], value)
    return {"docs": ids[order].astype("<i8").tobytes(), "n_null": int(null.sum()), "terms": terms.astype("<u8").tobytes(),
            "dfs": df.astype("<i8").tobytes(), **tree.packed()}


def rows_of_terms(dfs: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Row of every term of a dictionary: the most frequent first, then by hash."""
    row = np.empty(len(terms), np.int64)
    row[np.lexsort((terms, -dfs))] = np.arange(len(terms))
    return row


def build_index(docs: DataFrame, n_docs: int, n_terms: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each shard."""
    schema = arrow_schema(as_fields(_SHARD))

    def run(batches):
        from pyspark import TaskContext
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            ids, null, rows, terms, values, at = [], [], [], [], [], 0
            for i, nul, r, t, v in held:
                ids.append(i)
                null.append(nul)
                rows.append(r + at)
                terms.append(t)
                values.append(v)
                at += len(i)
            got = _shard(*(np.concatenate(x) for x in (ids, null, rows, terms, values)))
            return record_batch({c: [v] for c, v in {"part": part, "seq": seq, **got}.items()}, schema)

        for b in batches:
            data, offs = text_buffers(b.column(1))
            for x, y in slices(offs):
                row, term, tf, n = term_counts(data[offs[x]:offs[y]], offs[x:y + 1] - offs[x])
                some = np.flatnonzero(n > 0)
                if not len(some):
                    continue
                number = np.cumsum(n > 0) - 1
                ids = b.column(0).slice(x, y - x)
                null = ids.is_null().to_numpy(zero_copy_only=False)[some]
                values = impacts(tf, n[row], n_docs, n_terms)
                held.append((ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[some], null, number[row], term, values))
                size += len(row)
                if size >= POINTS:
                    yield flush()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield flush()

    return docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("body")).mapInArrow(tidy(run), _SHARD)


# ----------------------------------------------------------------- search --

def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, h): the distinct terms of every item."""
    def make():
        def kernel(data, offs, rows):
            row, h, _, _ = term_counts(data, offs)
            return {"item": rows.column(rows.schema.get_field_index("item")).take(pa.array(row)), "h": h.view(np.int64)}
        return kernel
    src = items.select(F.col(item).alias("item"), F.col(text).alias("body"))
    kind = src.schema["item"].dataType.simpleString()
    return map_texts(src, "body", make, f"item {kind}, h bigint", ["item"], one_to_one=False).distinct()


def _frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents each of ``terms`` (sorted) stands: from the shards' dictionaries."""
    schema = arrow_schema(as_fields("place int, df bigint"))
    wanted = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        total = np.zeros(len(wanted.value), np.int64)
        for b in batches:
            for raw, counts in zip(b.column(0), b.column(1)):
                own, df = np.frombuffer(raw.as_buffer(), "<u8"), np.frombuffer(counts.as_buffer(), "<i8")
                at = np.searchsorted(own, wanted.value)
                has = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == wanted.value) if len(own) else np.zeros(0, np.int64)
                total[has] += df[at[has]]
        got = np.flatnonzero(total)
        yield record_batch({"place": got.astype(np.int32), "df": total[got]}, schema)

    out = np.zeros(len(terms), np.int64)
    rows = index.select("terms", "dfs").mapInArrow(tidy(run), "place int, df bigint").groupBy("place").agg(F.sum("df").alias("df"))
    for r in rows.toLocalIterator():                 # at most a row for each of the block's terms
        out[r["place"]] = r["df"]
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1))) in doubles; 0 for a term that no document holds."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)


_HITS = "query int, doc bigint, score bigint"


def _searched(index: DataFrame, block, k: int, floors) -> DataFrame:
    """Every shard's k best documents for each query of the block, at or over the query's floor."""
    schema = arrow_schema(as_fields(_HITS))

    def run(batches):
        bounds, terms, term_weights = block.value
        least = floors.value.copy()                  # rises with what the task's own shards reach
        reached = [np.zeros(0, np.int64)] * len(least)
        for b in batches:
            for i in range(b.num_rows):
                shard = {f.name: b.column(j)[i].as_py() for j, f in enumerate(b.schema)}
                own, df = np.frombuffer(shard["terms"], "<u8"), np.frombuffer(shard["dfs"], "<i8")
                ids, n_null, tree = np.frombuffer(shard["docs"], "<i8"), shard["n_null"], Treap.unpacked(shard)
                row_of = rows_of_terms(df, own)
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                has = (own[at] == terms) & (term_weights > 0)
                out = ([], [], [])
                for q in range(len(least)):
                    sel = np.flatnonzero(has[bounds[q]:bounds[q + 1]]) + bounds[q]
                    cols, scores = tree.best(row_of[at[sel]], term_weights[sel], k, int(least[q]))
                    if not len(cols):
                        continue
                    best = np.sort(np.concatenate([reached[q], scores]))[::-1][:k]
                    reached[q] = best
                    if len(best) == k:
                        least[q] = max(least[q], best[-1])
                    out[0].append(np.full(len(cols), q, np.int32))
                    out[1].append(pa.array(ids[cols], pa.int64(), mask=cols >= len(ids) - n_null))
                    out[2].append(scores)
                if out[0]:
                    yield record_batch({"query": np.concatenate(out[0]), "doc": pa.concat_arrays(out[1]), "score": np.concatenate(out[2])}, schema)

    return index.mapInArrow(tidy(run), _HITS)


def search(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): every item's k best documents."""
    spark = docs.sparkSession
    n_docs, n_terms = statistics(docs, text)
    index = stored(build_index(docs, n_docs, n_terms, doc, text))
    query = stored(item_terms(items, item, item_text))
    named = stored(query.groupBy("item").agg(F.count("*").alias("n")))
    total = named.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK))
    kind = query.schema["item"].dataType.simpleString()
    found = None
    for b in range(blocks):
        mine = query.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        by_item: dict = {}
        for r in mine.toLocalIterator():             # a block: about BLOCK terms
            by_item.setdefault(r["item"], []).append(r["h"])
        names = list(by_item)
        hashes = np.array([h for v in by_item.values() for h in v], np.int64).view(np.uint64)
        bounds = np.concatenate([[0], np.cumsum([len(v) for v in by_item.values()])]).astype(np.int64)
        terms, inverse = np.unique(hashes, return_inverse=True)
        weight = weights(_frequencies(index, terms), n_docs)[inverse]
        block = spark.sparkContext.broadcast((bounds, hashes, weight))
        none = spark.sparkContext.broadcast(np.zeros(len(names), np.int64))
        early = stored(_searched(index.filter("part % 8 = 0"), block, k, none))
        ranked = early.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc())))
        least = np.zeros(len(names), np.int64)
        for r in ranked.filter(F.col("r") == k).select("query", "score").toLocalIterator():      # at most a row for each query
            least[r["query"]] = r["score"]
        late = _searched(index.filter("part % 8 <> 0"), block, k, spark.sparkContext.broadcast(least))
        of = spark.createDataFrame([(i, name) for i, name in enumerate(names)], f"query int, item {kind}")
        hits = early.unionByName(late)
        place = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))
        top = hits.withColumn("rank", place).filter(F.col("rank") <= k)
        got = top.join(F.broadcast(of), "query").select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
        found = got if found is None else found.unionByName(got)
    return found
