"""N-gram Jaccard join: near-duplicate groups by exact set similarity, verified in prefix trees.

A text's set are its distinct shingles of ``k`` words. Two texts link when
``100 * common >= percent * union``; a group is what links connect.

1. One pass gives each text its set's size and 128-bit sum, and a sketch that counts shingles in
   ``2**bits`` cells (bits grow with the rows, within fixed bounds). Equal sets become one class.
2. A second pass, over one text of each class, orders each set by one order for all: shingles in
   crowded cells of the sketch last, else by hash. Texts that link share one of their first
   ``size - ceil(size * percent / 100) + 1`` shingles in any such order, so only those are
   shuffled. The sketch decides how long the candidate lists get, never which pairs link.
3. Texts that share one of them, and whose sizes and positions allow a link, are candidates. In
   a list of at most ``LIST`` texts each such pair is noted. Longer lists, and shingles that the
   sketch knows to be frequent, note their members only, and connect them to families.
   The pass of step 1 also gives each set a parity signature: bit ``hash mod width`` is flipped
   for each shingle, so two signatures differ in no more bits than the sets in shingles. Pairs,
   and in families all texts against each other, whose signatures differ too much are left.
   What remains connects texts to blocks, as a spanning forest for each task.
4. A block's sets are joined by a prefix tree: sets in one order, most shared shingle first, share
   the nodes of common prefixes; a query walks down with its overlap so far, and leaves a subtree
   when the shingles left on either side cannot make up the overlap that a link needs. Blocks of
   over ``TILE`` shingles are cut into parts, and each pair of parts is a task's tree and queries.
5. Links found (no more than a spanning forest for each task) are connected to components.

Every text is represented: equal sets by the class, links between different sets by step 4.

Defined cases: a text with fewer than ``k`` words, but not none, has one shingle, its word
sequence. A null or empty text has no set and links with nothing. A row with a null id is no node
and links nothing: its component is that of an equal set that has an id, else null.
Rows that share an id are one node, and each is returned with its own set's size. Only the id
and text are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_fields, binary_rows, map_texts, record_batch, small_side, stored, tidy
from .components import connected_components
from .textbytes import NONSPACE, inside, mixed, window_hashes, words

LIST = 64
TILE = 1 << 20
SIGNATURES = 8 << 20         # bytes of signatures in a tile
_CHUNK = 1 << 14


def shingle_sets(data, offs, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after the other, and their bounds."""
    w = words(data, offs, NONSPACE)
    wh, total, counts = w.hashes(), len(w.start), w.counts
    full = window_hashes(wh, k)[inside(w.first, k, total)]
    per_row = np.maximum(counts - k + 1, 0)
    at = np.concatenate([[0], np.cumsum(per_row)])
    sets = []
    for r, c in enumerate(counts.tolist()):
        if c >= k:
            sets.append(np.unique(full[at[r]:at[r + 1]]))
        elif c:
            sets.append(window_hashes(wh[w.first[r]:w.first[r + 1]], c))
        else:
            sets.append(np.zeros(0, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds


def _sums(values, bounds):
    """Two 64-bit sums of each set: equal for equal sets."""
    a = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values + np.uint64(0x51ED270B)))])
    b = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values * np.uint64(0x2545F4914F6CDD1D) + np.uint64(11)))])
    return [(x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in (a, b)]


def signature_bits(n: int) -> int:
    """Width for a set of n: a power of two of about 2n (fixed bounds)."""
    return min(1 << 17, max(256, 1 << (2 * n - 1).bit_length() if n else 0))


def signatures(values, bounds) -> list[bytes]:
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        width = signature_bits(b - a)
        odd = np.bincount((values[a:b] & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def folded(sig: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words folded to fewer words: the signature of a smaller width."""
    return np.bitwise_xor.reduce(sig.reshape(len(sig), -1, words), axis=1)


_SUMMARY = "doc bigint, n int, s1 bigint, s2 bigint, sig binary, chunk int, part int, counts binary"


def _summaries(docs: DataFrame, doc: str, text: str, k: int, bits: int) -> DataFrame:
    """A row for each text, and (chunk not null) the task's part of the sketch."""
    def make():
        from pyspark import TaskContext
        sketch = np.zeros(1 << bits, np.uint32)
        part = TaskContext.get().partitionId()

        def kernel(data, offs, rows):
            if data is None:
                chunks = range(0, len(sketch), _CHUNK)
                m = len(chunks)
                none = [None] * m
                return {"doc": none, "n": none, "s1": none, "s2": none, "sig": none, "chunk": [c // _CHUNK for c in chunks], "part": [part] * m,
                        "counts": [zlib.compress(sketch[c:c + _CHUNK].tobytes(), 1) for c in chunks]}
            values, bounds = shingle_sets(data, offs, k)
            np.add.at(sketch, (values >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
            s1, s2 = _sums(values, bounds)
            none = pa.nulls(len(s1))
            return {"doc": rows.column(rows.schema.get_field_index(doc)), "n": np.diff(bounds).astype(np.int32), "s1": s1, "s2": s2,
                    "sig": signatures(values, bounds), "chunk": none, "part": none, "counts": none}
        return kernel
    return map_texts(docs, text, make, _SUMMARY, [doc], one_to_one=False, finish=True)


def _crowded(summary: DataFrame, bits: int, total: int) -> np.ndarray:
    """Level of every cell: 0 where few shingles fall, else the more the higher. 2**bits bytes."""
    ddl = "chunk int, part int, counts binary"
    schema = arrow_schema(as_fields(ddl))
    least = 16 + 4 * total / (1 << bits)

    def added(tab: pa.Table) -> pa.Table:
        out = np.zeros(_CHUNK, np.int64)
        for c in tab["counts"].to_pylist():
            got = np.frombuffer(zlib.decompress(c), np.uint32)
            out[:len(got)] += got
        out = np.minimum(out, 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"chunk": tab["chunk"][:1], "part": pa.array([0], pa.int32()),
                         "counts": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())}, schema=schema)

    def levels(tab: pa.Table) -> pa.Table:
        out = np.frombuffer(zlib.decompress(added(tab)["counts"][0].as_py()), np.uint32)
        lev = np.where(out > least, 1 + np.log2(np.maximum(out, 1) / least), 0).astype(np.uint8)
        return pa.table({"chunk": tab["chunk"][:1], "part": pa.array([0], pa.int32()),
                         "counts": pa.array([zlib.compress(lev.tobytes(), 1)], pa.binary())}, schema=schema)

    got = summary.filter("chunk IS NOT NULL").select("chunk", "part", "counts")
    got = got.groupBy("chunk", F.expr("part div 64")).applyInArrow(added, ddl)
    got = got.groupBy("chunk").applyInArrow(levels, ddl)
    out = np.zeros(max(1 << bits, _CHUNK), np.uint8)
    for r in got.collect():                     # the sketch: a fixed number of bytes
        out[r["chunk"] * _CHUNK:(r["chunk"] + 1) * _CHUNK] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return out[:1 << bits]


def needed(a, b, percent: int):
    """Smallest overlap with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def _prefixes(docs: DataFrame, doc: str, text: str, k: int, percent: int, bits: int, levels) -> DataFrame:
    """(h, doc, n, pos, hot): the first shingles of every set in the common order."""
    def make():
        level = levels.value

        def kernel(data, offs, rows):
            values, bounds = shingle_sets(data, offs, k)
            lev = level[(values >> np.uint64(64 - bits)).astype(np.int64)]
            sizes = np.diff(bounds)
            ids = rows.column(rows.schema.get_field_index(doc)).to_numpy(zero_copy_only=False)
            hs, hots, poss = [], [], []
            take = np.where(sizes > 0, sizes - (-(-percent * sizes // 100)) + 1, 0)
            for r, (a, b, p) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), take.tolist())):
                if p:
                    order = np.argsort(lev[a:b], kind="stable")[:p]      # values are sorted by hash already
                    hs.append(values[a:b][order])
                    hots.append(lev[a:b][order])
                    poss.append(np.arange(p, dtype=np.int32))
            cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            return {"h": cat(hs, np.uint64).view(np.int64), "doc": np.repeat(ids, take).astype(np.int64),
                    "n": np.repeat(sizes, take).astype(np.int32), "pos": cat(poss, np.int32), "hot": cat(hots, np.uint8) > 0}
        return kernel
    return map_texts(docs, text, make, "h bigint, doc bigint, n int, pos int, hot boolean", [doc], one_to_one=False)


def _candidates(prefixes: DataFrame, percent: int) -> DataFrame:
    """(h, a, b): pairs that may link (h null), and members of a frequent shingle's list (b null)."""
    ddl = "h bigint, a bigint, b bigint"
    schema = arrow_schema(as_fields(ddl))
    rare = prefixes.filter("NOT hot").select("h", "doc", "n", "pos")
    rare = rare.repartition("h").sortWithinPartitions("h", "n", "doc")

    def pairs_of(h, doc, n, pos):
        """Pairs of a list: rows i and i + d, for every d up to the longest list."""
        left, right = [], []
        for d in range(1, LIST):
            if d >= len(h):
                break
            i = np.flatnonzero(h[d:] == h[:-d])
            if not len(i):
                break
            j = i + d
            ok = (doc[i] != doc[j]) & (100 * n[i] >= percent * n[j])       # n[i] <= n[j] within a list
            ok &= 1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1 >= needed(n[i], n[j], percent)
            left.append(doc[i[ok]])
            right.append(doc[j[ok]])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x, y = np.concatenate(left), np.concatenate(right)
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        return both[:, 0], both[:, 1]

    def run(batches):
        held, long_h = [np.zeros(0, np.int64)] * 4, None
        def work(cols, end):
            nonlocal held, long_h
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
            h, doc, n, pos = cols
            out = []
            if long_h is not None and len(h):        # the list that was too long goes on
                m = int(np.searchsorted(h != long_h, True))
                if m:
                    out.append((h[:m], doc[:m], None))
                    h, doc, n, pos = (c[m:] for c in (h, doc, n, pos))
                if len(h):
                    long_h = None
            if len(h):
                at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                size = np.diff(np.concatenate([at, [len(h)]]))
                if not end and size[-1] <= LIST:     # the last list may go on
                    held = [c[at[-1]:] for c in (h, doc, n, pos)]
                    at, size = at[:-1], size[:-1]
                    h, doc, n, pos = (c[:len(c) - len(held[0])] for c in (h, doc, n, pos))
                else:
                    held = [np.zeros(0, np.int64)] * 4
                    long_h = h[-1] if size[-1] > LIST else None
                of = np.repeat(size, size)
                many = of > LIST
                if many.any():
                    out.append((h[many], doc[many], None))
                some = (of > 1) & ~many
                x, y = pairs_of(h[some], doc[some], n[some], pos[some])
                if len(x):
                    out.append((None, x, y))
            else:
                held = [np.zeros(0, np.int64)] * 4
            for hh, a, bb in out:
                yield record_batch({"h": pa.nulls(len(a), pa.int64()) if hh is None else hh, "a": a,
                                    "b": pa.nulls(len(a), pa.int64()) if bb is None else bb}, schema)

        for b in batches:
            yield from work([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], False)
        yield from work([np.zeros(0, np.int64)] * 4, True)

    found = rare.mapInArrow(tidy(run), ddl).distinct()
    hot = prefixes.filter("hot").select("h", F.col("doc").alias("a"), F.lit(None).cast("bigint").alias("b"))
    return found.unionByName(hot)


# ------------------------------------------------------------ prefix tree --

class Trie:
    """Compressed prefix tree over sets of token ranks (each ascending)."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        nodes = [[-1, 0, 0, 0]]               # parent, tokens from, to (in ``flat``), depth at its end
        ends: list[list[int]] = [[]]          # sets that end at a node
        flat, size = [], 0
        path, last = [0], np.zeros(0, np.uint32)
        for i in order:
            s = sets[i]
            m = min(len(s), len(last))
            differ = np.flatnonzero(s[:m] != last[:m])
            lcp = int(differ[0]) if len(differ) else m
            while len(path) > 1 and nodes[path[-2]][3] >= lcp and nodes[path[-1]][3] > lcp:
                path.pop()
            top = path[-1]
            if nodes[top][3] > lcp:           # cut the edge: an upper node takes its place in the path
                parent, a, b, depth = nodes[top]
                cut = b - (depth - lcp)
                nodes.append([parent, a, cut, lcp])
                ends.append([])
                nodes[top][0], nodes[top][1] = len(nodes) - 1, cut
                path[-1] = len(nodes) - 1
                top = path[-1]
            if len(s) > lcp:
                flat.append(s[lcp:])
                nodes.append([top, size, size + len(s) - lcp, len(s)])
                ends.append([i])
                size += len(s) - lcp
                path.append(len(nodes) - 1)
            else:
                ends[top].append(i)
            last = s
        arr = np.array(nodes, np.int64)
        self.parent, self.a, self.b, self.depth = arr.T
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        self.ends = ends
        n = len(nodes)
        self.last = np.where(self.b > self.a, self.flat[np.maximum(self.b - 1, 0)] if len(self.flat) else 0, 0)
        low, high = np.full(n, 1 << 40, np.int64), np.full(n, -1, np.int64)
        for v in range(n):
            if ends[v]:
                low[v] = high[v] = self.depth[v]
        for v in np.argsort(-self.depth, kind="stable").tolist():      # deeper nodes first
            p = self.parent[v]
            if p >= 0:
                low[p], high[p] = min(low[p], low[v]), max(high[p], high[v])
        self.low, self.high = low, high
        kids = np.argsort(self.parent, kind="stable")
        kids = kids[self.parent[kids] >= 0]
        self.kids = kids
        self.kid_at = np.searchsorted(self.parent[kids], np.arange(n + 1))
        self.has_end = np.array([bool(e) for e in ends])

    def linked(self, q: np.ndarray, n_ranks: int, percent: int) -> list[int]:
        """Sets that link with the set of ranks ``q``."""
        size = len(q)
        least, most = -(-percent * size // 100), 100 * size // percent
        member = np.zeros(n_ranks, bool)
        member[q] = True
        got = np.concatenate([[0], np.cumsum(member[self.flat])])
        front, over, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(front):
            a, b = self.kid_at[front], self.kid_at[front + 1]
            n = b - a
            v = self.kids[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            o = np.repeat(over, n) + got[self.b[v]] - got[self.a[v]]
            left = np.minimum(size - np.searchsorted(q, self.last[v], "right"), self.high[v] - self.depth[v])
            smallest = np.maximum(self.low[v], least)
            stay = (self.high[v] >= least) & (self.low[v] <= most) & (o + left >= needed(size, smallest, percent))
            front, over = v[stay], o[stay]
            for u, x in zip(front[self.has_end[front]].tolist(), over[self.has_end[front]].tolist()):
                if 100 * x >= percent * (size + int(self.depth[u]) - x):
                    found.extend(self.ends[u])
        return found


def links_within(ids, sets: list[np.ndarray], queries: list[int], tree: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``queries`` and ``tree`` (indices into ids and sets of hashes)."""
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    tokens, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.uint32)
    rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens), dtype=np.uint32)      # most shared first
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    ranked = rank[inverse]
    seqs = [np.sort(ranked[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    trie = Trie([seqs[i] for i in tree])
    forest, out = Forest(len(sets)), []
    for q in queries:
        for t in trie.linked(seqs[q], len(tokens), percent):
            if ids[q] != ids[tree[t]] and forest.joins(q, tree[t]):
                out.append((ids[q], ids[tree[t]]))
    return out


def _near_pairs(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures differ in no more bits than the sets of a link can."""
    one = sigs.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = sigs.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    ddl = "a bigint, b bigint"
    schema = arrow_schema(as_fields(ddl))

    def run(batches):
        for t in batches:
            a, b, na, nb, sa, sb = (c.to_pylist() for c in t.columns)
            keep = [i for i in range(len(a)) if near(na[i], sa[i], nb[i], sb[i], percent)]
            yield record_batch({"a": [a[i] for i in keep], "b": [b[i] for i in keep]}, schema)

    return (pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(run), ddl))


def near(na: int, sa: bytes, nb: int, sb: bytes, percent: int) -> bool:
    x, y = np.frombuffer(sa, np.uint64)[None], np.frombuffer(sb, np.uint64)[None]
    w = min(x.shape[1], y.shape[1])
    return int(np.bitwise_count(folded(x, w) ^ folded(y, w)).sum()) <= na + nb - 2 * needed(na, nb, percent)


class Forest:
    """Union-find that says which edges join two trees."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def joins(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.root[x] = y
        return x != y


def near_within(ids, n: np.ndarray, sigs: list[bytes], queries: list[int], tree: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``queries`` x ``tree`` whose sizes and signatures allow a link."""
    widths = np.array([len(s) // 8 for s in sigs])
    forest, out = Forest(len(ids)), []
    tree = sorted(tree, key=lambda i: int(n[i]))
    at, sizes = np.array(tree), n[tree]
    by_width = {int(w): (pos := np.flatnonzero(widths[at] == w), np.stack([np.frombuffer(sigs[at[i]], np.uint64) for i in pos]))
                for w in np.unique(widths[at])}
    for q in queries:
        size, mine = int(n[q]), np.frombuffer(sigs[q], np.uint64)[None]
        lo = np.searchsorted(sizes, -(-percent * size // 100))
        hi = np.searchsorted(sizes, 100 * size // percent, "right")
        for w, (pos, rows) in by_width.items():
            a, b = np.searchsorted(pos, lo), np.searchsorted(pos, hi)
            if a == b:
                continue
            m = min(w, mine.shape[1])
            differ = np.bitwise_count(folded(rows[a:b], m) ^ folded(mine, m)).sum(1, dtype=np.int64)
            other = at[pos[a:b]]
            for t in other[differ <= size + n[other] - 2 * needed(size, n[other], percent)].tolist():
                if ids[q] != ids[t] and forest.joins(q, t):
                    out.append((ids[q], ids[t]))
    return out


def _tiled(rows: DataFrame, blocks: DataFrame, weight: str, most: int, work) -> DataFrame:
    """(a, b) of ``work(ids, n, values, queries, tree)`` over every pair of parts of every block.

    ``rows``: (doc, n, value); ``blocks``: (node, component). A block of ``weight`` over ``most``
    is dealt by the ids' hash to parts; part i meets part j >= i in tile (i, j). A tile's rows are
    put in one order first: a task that is run again, with its input fetched in another order,
    then gives the same forest.
    """
    mine = rows.join(blocks, F.col("doc") == F.col("node"))
    sized = stored(mine.groupBy("component").agg(F.ceil(F.sum(F.expr(weight)) / F.lit(most / 2)).cast("int").alias("parts")))
    of = mine.join(sized, "component").withColumn("mine", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    tiles = of.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.select("component", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"),
                         "mine", "doc", "n", "value")
    ddl = "a bigint, b bigint"
    schema = arrow_schema(as_fields(ddl))

    def join(tab: pa.Table) -> pa.Table:
        x, y = tab["x"][0].as_py(), tab["y"][0].as_py()
        rows = sorted(zip(*(tab[c].to_pylist() for c in ("doc", "n", "value", "mine"))))
        ids, n, values, part = zip(*rows)
        got = work(ids, np.array(n, np.int64), values,
                   [i for i, m in enumerate(part) if m == y], [i for i, m in enumerate(part) if m == x])
        return pa.table({"a": [g[0] for g in got], "b": [g[1] for g in got]}, schema=schema)

    return tiles.groupBy("component", "x", "y").applyInArrow(join, ddl)


def near_duplicate_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 5,
                          percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    docs = docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("body"))
    spark = docs.sparkSession
    bits = min(26, max(16, math.ceil(math.log2(16 * max(1, docs.count())))))
    summary = stored(_summaries(docs, "doc", "body", k, bits))
    texts = summary.filter("chunk IS NULL").select("doc", "n", "s1", "s2")
    total = texts.agg(F.sum("n")).first()[0] or 0
    classes = stored(texts.filter("n > 0 AND doc IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc").alias("rep")))
    member = texts.join(classes, ["n", "s1", "s2"], "left")
    copies = member.filter("doc <> rep").select("doc", "rep").distinct()
    reps = classes.select(F.col("rep").alias("doc"))
    skip = stored(copies.select("doc").distinct().join(reps, "doc", "left_anti"))
    # An id that repeats with other texts ties their classes together.
    several = (member.filter("rep IS NOT NULL").groupBy("doc").agg(F.min("rep").alias("b"), F.max("rep").alias("hi"))
               .filter("b < hi").select("doc", "b"))
    same_node = member.join(several, "doc").select(F.col("rep").alias("a"), "b").filter("a <> b").distinct()
    chosen = docs.filter("doc IS NOT NULL").join(small_side(skip, 16), "doc", "left_anti")

    levels = spark.sparkContext.broadcast(_crowded(summary, bits, total))
    cand = stored(_candidates(_prefixes(chosen, "doc", "body", k, percent, bits, levels), percent))
    member_rows = cand.filter("h IS NOT NULL").select("h", "a")
    stars = member_rows.groupBy("h").agg(F.min("a").alias("b"))
    sigs = summary.filter("n > 0").select("doc", "n", "sig")
    families = connected_components(member_rows.join(stars, "h").filter("a <> b").select("a", "b").distinct())
    near_kin = _tiled(sigs.withColumnRenamed("sig", "value"), families, "octet_length(value)", SIGNATURES,
                      lambda ids, n, values, q, t: near_within(ids, n, values, q, t, percent))
    pairs = _near_pairs(cand.filter("h IS NULL").select("a", "b"), sigs, percent)
    blocks = connected_components(pairs.unionByName(near_kin))

    def sets_kernel():
        def kernel(data, offs, rows):
            values, bounds = shingle_sets(data, offs, k)
            return {"n": np.diff(bounds).astype(np.int32), "tokens": binary_rows(values, bounds)}
        return kernel
    wanted = chosen.join(small_side(blocks.select(F.col("node").alias("doc")), 16), "doc", "left_semi")
    sets = stored(map_texts(wanted, "body", sets_kernel, "n int, tokens binary", ["doc"]))
    links = _tiled(sets.withColumnRenamed("tokens", "value"), blocks, "n", TILE, lambda ids, n, values, q, t: links_within(
        ids, [np.frombuffer(v, np.uint64) for v in values], q, t, percent))
    groups = connected_components(links.unionByName(same_node))
    # Equal sets share the class's component; texts without a set are alone.
    out = member.join(groups, F.col("rep") == F.col("node"), "left")
    return out.select(F.col("doc").alias(doc), F.col("n").cast("bigint").alias("n_shingles"),
                      F.coalesce("component", "rep", "doc").alias("component_id"))
