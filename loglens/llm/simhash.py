"""SimHash near-dedup: fingerprints that differ in few bits, by a grid over segment bit counts.

1. A batch map gives each text a 64-bit fingerprint: a bit is 1 if over half the XXH64 hashes of
   the text's shingles have it. Equal fingerprints become one class (partial aggregation).
2. Embedding: a fingerprint's 64 bits are cut into 32 segments of two bits; its point are the bit
   counts of the segments. Two fingerprints differ in at least as many bits as their points'
   Manhattan distance.
3. Grid: of two points at distance 4 or less, one half (16 segments) is at distance 2 or less. So
   for each half a point is put into its own cell and all cells at distance 1: points that
   near meet in one of them, the cell of either or one between. About 50 small rows a class.
4. Cells are streamed in the order of a shuffle. In a cell, points that came over the same
   neighbour step are equal there and meet in their own cell, so only points of different steps, and
   those at home, are compared; candidates' fingerprints are compared exactly. A cell of over
   ``TILE`` points is dealt to parts by hash, and each pair of parts is a task's work.
5. Links are connected to components; a cell gives no more links than it has points beyond lists
   of ``SHORT``. Classes of many rows, a thousandth or more, are broadcast for the last join.

Every pair of fingerprints at ``BITS`` or less is found; the work in a cell is quadratic in the
different fingerprints that it holds (not in the documents).

Defined cases: a null or empty text has the fingerprint zero, which links like any other; a text of
fewer words than a shingle is one shingle. Documents are rows: those with one id and other texts are
not linked by the id. A row with a null id is linked, but is no component's id: a component of such
rows only has a null id. Only the id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_fields, map_texts, record_batch, stored, tidy
from .components import connected_components
from .skew import left_join

BITS = 4
SEED = 42
SHORT = 32           # lists up to this size are compared by shifts over the whole batch
TILE = 2048
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_ODD = np.uint64(0x5555555555555555)
_HALF = np.uint64(0xFFFFFFFF)


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 of every run of ``k`` words, joined by one blank; of the whole if it has fewer."""
    said = text.translate(_LOWER).split()            # splits at \\x20 and \\x09-\\x0D
    if not said:
        return []
    joined, digest = b" ".join(said), xxhash.xxh64_intdigest
    if len(said) <= k:
        return [digest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in said]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())]


def fingerprints_of(texts: list[bytes], k: int = 4) -> np.ndarray:
    """64-bit fingerprints."""
    out = np.zeros(len(texts), np.uint64)
    hashes, sizes = [], []
    for t in texts:
        got = shingle_hashes(t, k)
        hashes.append(np.array(got, np.uint64))
        sizes.append(len(got))
    some = [i for i, n in enumerate(sizes) if n]
    at = 0
    while at < len(some):                            # about 2**16 shingles at once, or one text
        end, total = at, 0
        while end < len(some) and (end == at or total + sizes[some[end]] <= 1 << 16):
            total += sizes[some[end]]
            end += 1
        rows = some[at:end]
        n = np.array([sizes[i] for i in rows])
        h = np.concatenate([hashes[i] for i in rows])
        counts = np.zeros((len(rows), 64), np.int64)
        if len(rows) == 1:
            for a in range(0, len(h), 1 << 16):
                counts[0] += np.unpackbits(h[a:a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[:] = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0, dtype=np.int32)
        on = np.packbits((2 * counts > n[:, None]).astype(np.uint8), axis=1, bitorder="little")
        out[rows] = np.ascontiguousarray(on).view(np.uint64)[:, 0]
        at = end
    return out


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """(doc, fp) of every row."""
    def make():
        def kernel(data, offs, rows):
            raw = data.tobytes()
            o = offs.tolist()
            return {"fp": fingerprints_of([raw[a:b] for a, b in zip(o, o[1:])], k).view(np.int64)}
        return kernel
    return map_texts(docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("body")), "body", make, "fp bigint", ["doc"])


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each in its two bits."""
    return (fp & _ODD) + ((fp >> np.uint64(1)) & _ODD)


def grid_rows(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, step, fingerprint): own cell (step 0) and all at distance 1, for both halves."""
    point = segment_counts(fp)
    cells, steps, fps = [], [], []
    for half in (0, 1):
        own = (point >> np.uint64(32 * half)) & _HALF
        mark = np.uint64(half) << np.uint64(32)
        cells.append(own | mark)
        steps.append(np.zeros(len(fp), np.int16))
        fps.append(fp)
        for s in range(16):
            v, one = (own >> np.uint64(2 * s)) & np.uint64(3), np.uint64(1 << (2 * s))
            for ok, moved, step in ((v < 2, own + one, 1 + 2 * s), (v > 0, own - one, 2 + 2 * s)):
                cells.append(moved[ok] | mark)
                steps.append(np.full(int(ok.sum()), step, np.int16))
                fps.append(fp[ok])
    return np.concatenate(cells), np.concatenate(steps), np.concatenate(fps)


def _grid(classes: DataFrame) -> DataFrame:
    ddl = "cell bigint, step smallint, fp bigint"
    schema = arrow_schema(as_fields(ddl))

    def run(batches):
        for b in batches:
            cell, step, fp = grid_rows(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            yield record_batch({"cell": cell.view(np.int64), "step": step, "fp": fp.view(np.int64)}, schema)

    return classes.select("fp").mapInArrow(tidy(run), ddl)


def stars_within(fp: np.ndarray, step: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links between a cell's points connect: each to its component's first point."""
    order = np.lexsort((step, fp))
    fp, step = fp[order], step[order]
    n = len(fp)
    near = np.zeros((n, n), bool)
    for a in range(0, n, 256):
        part = np.bitwise_count(fp[a:a + 256, None] ^ fp[None]) <= bits
        part &= (step[a:a + 256, None] != step[None]) | (step[a:a + 256, None] == 0)
        near[a:a + 256] = part
    np.fill_diagonal(near, True)
    label = np.arange(n)
    some = np.flatnonzero(near.sum(1) > 1)
    while len(some):
        was = label.copy()
        for a in range(0, len(some), 256):
            rows = some[a:a + 256]
            label[rows] = np.minimum(label[rows], np.where(near[rows], was[None], n).min(1))
        label = label[label]
        if (label == was).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return fp[label[moved]], fp[moved]


def _pairs_by_shift(cell, step, fp, bits):
    """Links of lists of up to ``SHORT`` points: rows i and i + d for every d."""
    left, right = [], []
    for d in range(1, SHORT):
        if d >= len(cell):
            break
        i = np.flatnonzero(cell[d:] == cell[:-d])
        if not len(i):
            break
        j = i + d
        near = np.bitwise_count(fp[i] ^ fp[j]) <= bits
        near &= (step[i] != step[j]) | (step[i] == 0)
        left.append(fp[i[near]])
        right.append(fp[j[near]])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return cat(left), cat(right)


_FOUND = "a bigint, b bigint, cell bigint, step smallint"


def _streamed(grid: DataFrame, bits: int) -> DataFrame:
    """Links (cell null), and the points of cells of over ``TILE`` points (b null)."""
    schema = arrow_schema(as_fields(_FOUND))
    ordered = grid.repartition("cell").sortWithinPartitions("cell", "step", "fp")

    def batch(a, b=None, cell=None, step=None):
        none = lambda t: pa.nulls(len(a), t)
        return record_batch({"a": a.view(np.int64), "b": none(pa.int64()) if b is None else b.view(np.int64),
                             "cell": none(pa.int64()) if cell is None else cell.view(np.int64),
                             "step": none(pa.int16()) if step is None else step}, schema)

    def run(batches):
        held = (np.zeros(0, np.uint64), np.zeros(0, np.int16), np.zeros(0, np.uint64))
        over = None                                  # the cell that has already more than TILE points

        def work(cols, end):
            nonlocal held, over
            cell, step, fp = (np.concatenate([x, y]) for x, y in zip(held, cols))
            held = tuple(c[:0] for c in (cell, step, fp))
            if over is not None and len(cell):
                m = int(np.searchsorted(cell, over, "right"))
                if m:
                    yield batch(fp[:m], cell=cell[:m], step=step[:m])
                    cell, step, fp = cell[m:], step[m:], fp[m:]
                if len(cell):
                    over = None
            if not len(cell):
                return
            at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            size = np.diff(np.concatenate([at, [len(cell)]]))
            if not end and size[-1] <= TILE:         # the last cell may go on
                held = tuple(c[at[-1]:] for c in (cell, step, fp))
                cell, step, fp = (c[:at[-1]] for c in (cell, step, fp))
                at, size = at[:-1], size[:-1]
            elif not end:
                over = cell[-1]
            of = np.repeat(size, size)
            if (many := of > TILE).any():
                yield batch(fp[many], cell=cell[many], step=step[many])
            some = (of > 1) & (of <= SHORT)
            a, b = _pairs_by_shift(cell[some], step[some], fp[some], bits)
            if len(a):
                yield batch(a, b)
            for i in np.flatnonzero((size > SHORT) & (size <= TILE)).tolist():
                rows = slice(at[i], at[i] + size[i])
                a, b = stars_within(fp[rows], step[rows], bits)
                if len(a):
                    yield batch(a, b)

        for b in batches:
            cell, step, fp = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            yield from work((cell.astype(np.int64).view(np.uint64), step, fp.astype(np.int64).view(np.uint64)), False)
        yield from work(tuple(c[:0] for c in held), True)

    return ordered.mapInArrow(tidy(run), _FOUND)


def _of_tiles(points: DataFrame, bits: int) -> DataFrame:
    """Links within cells of many points: each pair of their parts is one group."""
    sized = stored(points.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(TILE / 2)).cast("int").alias("parts")))
    tiles = (points.join(sized, "cell").withColumn("mine", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("cell", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "a", "step"))
    ddl = "a bigint, b bigint"
    schema = arrow_schema(as_fields(ddl))

    def join(tab: pa.Table) -> pa.Table:
        fp = tab["a"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        a, b = stars_within(fp, tab["step"].combine_chunks().to_numpy(zero_copy_only=False), bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)}, schema=schema)

    return tiles.groupBy("cell", "x", "y").applyInArrow(join, ddl)


def links(classes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): fingerprints (fp) of ``classes`` whose connections are those of all pairs at ``bits`` or less."""
    if not 0 <= bits <= 4:
        raise ValueError("the grid finds distances up to 4")
    found = stored(_streamed(_grid(classes), bits))
    pairs = found.filter("cell IS NULL").select("a", "b")
    return pairs.unionByName(_of_tiles(found.filter("cell IS NOT NULL").select("a", "cell", "step"), bits)).distinct()


def near_duplicate_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 4, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row."""
    rows = stored(fingerprints(docs, doc, text, k))
    classes = stored(rows.groupBy("fp").agg(F.min("doc").alias("rep"), F.count("*").alias("n")))
    found = connected_components(links(classes, bits))
    rooted = classes.join(found, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fp"))
    ids = stored(rooted.select("fp", "rep", "n", "root"))
    least = stored(ids.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("fps")))
    of_class = stored(left_join(ids.select("fp", "n", "root"), least, "root", "fps", ids.count(), "fp"))
    got = left_join(rows, of_class.select("fp", "n", "component_id"), "fp", "n", rows.count(), "doc")
    return got.select(F.col("doc").alias(doc), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
