"""Benchmark decontamination: broadcast hash set of normalised test n-grams.

A window is ``n`` consecutive words of a benchmark item; an item of fewer words, but not
none, is one window of its own length. Tasks cut the items into windows, which are written
as a table (hash, item, words). It goes to every task as sorted hashes beside one buffer of
words. A task hashes all word windows of its texts, looks them up, and compares the words of
each hit with the window's own before it counts.

Size of what is broadcast: the bytes of the window table itself are summed first. Windows (not
items: one item may be longer than a block) are dealt to as many blocks as keep a block at about
``table_bytes``; each block is one pass over the documents, and the passes' hits are merged. So
nothing is capped, and neither the driver nor a worker holds more than a block (or one window,
if a single window is longer).

Defined cases: a null or empty text has no words. Null item ids count as the item ``""``.
Items that repeat count once by id; equal windows of two items count for both. Rows are
judged one by one, so repeated rows and repeated ids each give their own row. An empty
benchmark leaves every document clean. Columns other than the id and text are not looked
at; in ``annotate`` a column of the documents named like a result column gives way to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stored, text_buffers
from .textbytes import ALNUM, SEP, Words, inside, window_hashes, words

HIT_DDL = ("n_words bigint, n_hit bigint, item_ids array<string>, "
           "spans array<struct<start:int,end:int>>")
WINDOW_DDL = "size int, hash bigint, item string, window binary"
#: Bytes that a window takes in the table beside its words and its item's name: hash, offset, item number, pointers.
_ROW_BYTES = 40


def benchmark_windows(bench: DataFrame, item: str, text: str, n: int) -> DataFrame:
    """(size, hash, item, window): the different windows of every item, cut in tasks."""
    b = bench.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("body"))

    def make():
        def kernel(data, offs, rows):
            w = words(data, offs, ALNUM)
            names = rows.column(rows.schema.get_field_index("item"))
            wh, total, length = w.hashes(), len(w.start), w.end - w.start
            ends = np.cumsum(length + 1) - 1                # the words one after the other, a blank behind each
            joined = np.full(int(ends[-1]) + 1 if total else 0, SEP, np.uint8)
            joined[np.repeat(ends - length, length) + _counted(length)] = w.norm[np.repeat(w.start, length) + _counted(length)]
            joined = joined.tobytes()
            sizes, hashes, of, windows = [], [], [], []
            for size in np.unique(np.minimum(w.counts, n)).tolist():
                if not size:
                    continue
                at = np.flatnonzero(inside(w.first, size, total))
                row = np.searchsorted(w.first, at, "right") - 1
                own = np.minimum(w.counts[row], n) == size
                at, row = at[own], row[own]
                sizes += [size] * len(at)
                hashes.append(window_hashes(wh, size)[at].view(np.int64))
                of.append(row)
                windows += [joined[a:b] for a, b in zip((ends - length)[at].tolist(), ends[at + size - 1].tolist())]
            if not windows:
                return {"size": [], "hash": [], "item": [], "window": []}
            return {"size": sizes, "hash": np.concatenate(hashes), "item": names.take(pa.array(np.concatenate(of))), "window": windows}
        return kernel
    return map_texts(b, "body", make, WINDOW_DDL, ["item"], one_to_one=False).distinct()


def _counted(length: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each length, one after the other."""
    return np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)


def _window_table(rows: pa.Table) -> dict[int, tuple]:
    """length -> (sorted hashes, offsets of the windows' words, the words' bytes, item numbers, item names)."""
    out = {}
    size = rows.column("size").to_numpy()
    for n in np.unique(size).tolist():
        mine = rows.take(pa.array(np.flatnonzero(size == n)))
        order = pa.array(np.argsort(mine.column("hash").to_numpy().view(np.uint64), kind="stable"))
        mine = mine.take(order).combine_chunks()
        data, offs = text_buffers(mine.column("window"))
        items = mine.column("item").combine_chunks().dictionary_encode()
        out[n] = (mine.column("hash").to_numpy().view(np.uint64), offs, data.tobytes(),
                  items.indices.to_numpy(), items.dictionary.to_pylist())
    return out


def _kernel_maker(table):
    def make():
        sides = []
        for size, (keys, at, text, of, names) in sorted(table.value.items()):
            bits = min(24, max(16, len(keys).bit_length() + 4))     # at most one place in eight is taken, up to 2^21 keys
            shift = np.uint64(64 - bits)
            pre = np.zeros(1 << bits, bool)
            pre[keys >> shift] = True
            sides.append((size, keys, pre, shift, at, text, of, names))

        def kernel(data, offs, rows):
            w = words(data, offs, ALNUM)
            n_rows, total = len(offs) - 1, len(w.start)
            cover = np.zeros(total + 1, np.int32)
            found: dict[int, set] = {}
            wh = w.hashes() if sides else None
            for size, keys, pre, shift, at, text, of, names in sides:
                h = window_hashes(wh, size)
                cand = np.flatnonzero(pre[h >> shift])
                if not len(cand):
                    continue
                first = np.searchsorted(keys, h[cand])
                last = np.searchsorted(keys, h[cand], "right")
                hit = (last > first) & inside(w.first, size, total)[cand]
                cand, first, last = cand[hit], first[hit], last[hit]
                of_row = np.searchsorted(w.first, cand, "right") - 1
                for i, r, a, b in zip(cand.tolist(), of_row.tolist(), first.tolist(), last.tolist()):
                    own = w.text(i, size)
                    ids = [names[of[j]] for j in range(a, b) if text[at[j]:at[j + 1]] == own]   # the words themselves decide
                    if ids:
                        cover[i] += 1
                        cover[i + size] -= 1
                        found.setdefault(r, set()).update(ids)
            covered = np.cumsum(cover[:-1]) > 0
            sums = np.concatenate([[0], np.cumsum(covered)])
            ids, spans = [[]] * n_rows, [[]] * n_rows
            for r, got in found.items():
                ids[r] = sorted(got)
                spans[r] = _spans(data, offs, w, covered, r)
            return {"n_words": w.counts, "n_hit": sums[w.first[1:]] - sums[w.first[:-1]],
                    "item_ids": ids, "spans": spans}
        return kernel
    return make


def _spans(data, offs, w: Words, covered, r: int) -> list[dict]:
    """Runs of hit words of row r as code-point ranges of its text."""
    a, b = int(w.first[r]), int(w.first[r + 1])
    flags = np.concatenate([[0], covered[a:b].astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(flags))
    row = data[offs[r]:offs[r + 1]]
    points = np.concatenate([[0], np.cumsum((row & 0xC0) != 0x80)])
    return [{"start": int(points[w.start[a + x] - offs[r]]), "end": int(points[w.end[a + y - 1] - offs[r]])}
            for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())]


def window_blocks(windows: DataFrame, table_bytes: int) -> list[DataFrame]:
    """A written table of windows as tables of about ``table_bytes``."""
    row = F.octet_length("window") + F.octet_length("item") + _ROW_BYTES
    n = math.ceil((windows.agg(F.sum(row.cast("bigint"))).first()[0] or 0) / table_bytes)
    if n <= 1:
        return [windows]
    n += math.ceil(n / 4)                   # hashing deals a little unevenly
    return [windows.filter(F.pmod(F.xxhash64("hash", "item"), F.lit(n)) == k) for k in range(n)]


def annotate(docs: DataFrame, bench: DataFrame, n: int = 10, text: str = "text", item: str = "item_id",
             bench_text: str = "text", keep=None, table_bytes: int = 32 << 20) -> DataFrame:
    """The documents' columns (``keep``: all but clashing ones) with n_words, n_hit, item_ids and spans."""
    made = {"n_words", "n_hit", "item_ids", "spans"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    out = docs
    blocks = window_blocks(stored(benchmark_windows(bench, item, bench_text, n)), table_bytes)
    sc = docs.sparkSession.sparkContext
    if len(blocks) == 1:
        tab = sc.broadcast(_window_table(blocks[0].toArrow()))
        return map_texts(docs, text, _kernel_maker(tab), HIT_DDL, keep)
    for k, block in enumerate(blocks):      # each pass adds its own hits to the row
        tab = sc.broadcast(_window_table(block.toArrow()))
        got = map_texts(out, text, _kernel_maker(tab), HIT_DDL, [c for c in out.columns if c not in made])
        out = got.withColumn(f"_hits{k}", F.struct("item_ids", "spans", "n_words")).drop(*made)
    parts = [F.col(f"_hits{k}") for k in range(len(blocks))]
    ids = F.array_sort(F.array_distinct(F.flatten(F.array(*[p["item_ids"] for p in parts]))))
    merged = out.withColumn("item_ids", ids).withColumn("_all", F.flatten(F.array(*[p["spans"] for p in parts])))
    merged = merged.withColumn("n_words", parts[0]["n_words"]).drop(*[f"_hits{k}" for k in range(len(blocks))])
    return _merge_spans(merged, text, keep)


def _merge_spans(df: DataFrame, text: str, keep) -> DataFrame:
    """Union of overlapping spans and the number of words in it."""
    def make():
        def kernel(data, offs, rows):
            w = words(data, offs, ALNUM)
            spans, hits = [], []
            lists = rows.column(rows.schema.get_field_index("_all")).to_pylist()
            for r, got in enumerate(lists):
                a, b = int(w.first[r]), int(w.first[r + 1])
                if not got:
                    spans.append([])
                    hits.append(0)
                    continue
                row = data[offs[r]:offs[r + 1]]
                points = np.concatenate([[0], np.cumsum((row & 0xC0) != 0x80)])
                at = points[w.start[a:b] - offs[r]]
                flag = np.zeros(len(at) + 1, np.int32)
                np.add.at(flag, np.searchsorted(at, [s["start"] for s in got]), 1)
                np.add.at(flag, np.searchsorted(at, [s["end"] for s in got]), -1)
                covered = np.cumsum(flag[:-1]) > 0
                full = np.zeros(len(w.start), bool)
                full[a:b] = covered
                spans.append(_spans(data, offs, w, full, r))
                hits.append(int(covered.sum()))
            return {"n_hit": hits, "spans": spans}
        return kernel
    cols = [*dict.fromkeys([*keep, "n_words", "item_ids", "_all"])]
    got = map_texts(df, text, make, "n_hit bigint, spans array<struct<start:int,end:int>>", cols)
    return got.select(*keep, "n_words", "n_hit", "item_ids", "spans")


def without_spans(annotated: DataFrame, text: str = "text") -> DataFrame:
    """Cut the hit spans out of the text."""
    cut = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
                      lambda acc, s: F.struct(
                          F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])).alias("out"),
                          s["end"].alias("at")),
                      lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return annotated.withColumn(text, F.when(F.size("spans") > 0, cut).otherwise(F.col(text)))


def decontaminated(docs: DataFrame, bench: DataFrame, remove: str = "documents", n: int = 10) -> DataFrame:
    """The documents without contaminated ones (``remove="documents"``) or without hit spans (``"spans"``)."""
    own = {c: f"__own_{c}" for c in docs.columns if c in ("n_words", "n_hit", "item_ids", "spans")}
    got = annotate(docs.withColumnsRenamed(own), bench, n)
    got = got.filter("n_hit = 0") if remove == "documents" else without_spans(got)
    return got.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
