"""Language ID: script ranges narrow the candidates, Viterbi over word scores labels spans.

Training counts, over all labelled rows it is given, hashed letter bigrams and trigrams (with
word ends) for each language, and words for each script and language. The counts are summed
by Spark in fixed chunks; the model (``BUCKETS`` log ratios for each language) is all that
reaches the driver. A word's script (from code-point ranges) leaves only languages that write
at least ``MIN_SCRIPT`` of their words in it; a script that no language writes leaves a word
neutral. The Viterbi path over a text's words pays ``SWITCH`` for each change of language.

A text's label is the language that holds most letters of its path; the score is the share of
letters it holds. Ties go to the language with the larger total score, then to the first by name.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and no spans, as is
every text where no labelled row was given. Rows with a null language are not learned from. Rows
are judged one by one by their text alone, so repeated rows are given the same label. Only the
text (and for training the language) is read. A batch of texts is scored together, in at most
``WORDS`` words beyond the longest text.
"""

from __future__ import annotations

import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, as_fields, record_batch, tidy

BUCKETS = 1 << 16          # for each of the two n-gram lengths
SWITCH = 14.0
MIN_SCRIPT = 0.01
WORDS = 1_000_000
UND = "und"
# First code points of Unicode's script blocks.
_SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
            (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
            (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"),
            (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
            (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
            (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
            (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"),
            (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
            (0xFB13, "other"), (0x20000, "han"), (0x40000, "other")]
SCRIPT_NAMES = sorted({n for _, n in _SCRIPTS})


@cache
def _tables():
    """For every code point: its lower case, 0 if it can't stand in a word; whether it is a letter; its script.

    Words hold letters (category L, in all planes) and marks (M), as many scripts write vowels as marks.
    """
    lower, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            lower[c] = ord(low) if len(low) == 1 else c
            letter[c] = kind == "L"
    starts = np.array([s for s, _ in _SCRIPTS])
    ids = np.array([SCRIPT_NAMES.index(n) for _, n in _SCRIPTS], np.uint8)
    return lower, letter, ids[np.searchsorted(starts, np.arange(0x110000), "right") - 1]


class Letters:
    """Words (runs of letters and marks that hold a letter) of a batch of texts, and their hashed n-grams."""

    def __init__(self, texts: list[str]):
        lower, letter, script = _tables()
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.offs = np.concatenate([[0], np.cumsum(sizes)])
        x = lower[codes]
        mask = x > 0
        begins, ends = mask.copy(), mask.copy()
        begins[1:] &= ~mask[:-1]
        ends[:-1] &= ~mask[1:]
        full = sizes > 0
        at, last = self.offs[:-1][full], self.offs[1:][full] - 1
        begins[at], ends[last] = mask[at], mask[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        so_far = np.concatenate([[0], np.cumsum(letter[codes])])
        if (bare := so_far[self.start] == so_far[self.end]).any():       # marks alone are no word
            edge = np.zeros(len(mask) + 1, np.int8)
            edge[self.start[bare]] += 1
            edge[self.end[bare]] -= 1
            mask &= np.cumsum(edge[:-1]) == 0
            self.start, self.end = self.start[~bare], self.end[~bare]
        self.first = np.searchsorted(self.start, self.offs)
        self.script = script[codes[self.start]]
        # Letter sequence of all words, each followed by one 0.
        n = self.end - self.start
        self.bounds = np.concatenate([[0], np.cumsum(n + 1)])
        seq = np.zeros(int(self.bounds[-1]), np.uint32)
        to = np.ones(len(seq), bool)
        to[self.bounds[1:] - 1] = False
        seq[to] = x[mask]
        self.seq = seq

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        s = self.seq.astype(np.uint64)
        one = np.concatenate([[0], s[:-1]]).astype(np.uint64)
        two = np.concatenate([[0, 0], s[:-2]])[:len(s)].astype(np.uint64)
        two[one == 0] = 0
        k1, k2, k3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        h = (s + np.uint64(1)) * k1 ^ (one + np.uint64(3)) * k2
        bi = (h ^ (h >> np.uint64(29))) * k3 >> np.uint64(48)
        h ^= (two + np.uint64(7)) * k3
        tri = (h ^ (h >> np.uint64(31))) * k1 >> np.uint64(48)
        return bi.astype(np.int64), tri.astype(np.int64) + BUCKETS


# ---------------------------------------------------------------- training --

_CHUNK = 1 << 12


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """The model: languages, log ratios (2 * BUCKETS x languages), scripts allowed (scripts x languages)."""
    ddl = "lang string, chunk int, part int, counts binary"
    schema = arrow_schema(as_fields(ddl))
    n_feat = 2 * BUCKETS + len(SCRIPT_NAMES)

    def count(batches):
        from pyspark import TaskContext
        part, total = TaskContext.get().partitionId(), {}
        for b in batches:
            by: dict[str, list[str]] = {}
            for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(l, []).append(t)
            for l, texts in by.items():
                mine = total.setdefault(l, np.zeros(n_feat, np.int64))
                for a, z in _pieces(texts):
                    w = Letters(texts[a:z])
                    for g in w.grams():
                        mine += np.bincount(g, minlength=n_feat)
                    mine[2 * BUCKETS:] += np.bincount(w.script, minlength=len(SCRIPT_NAMES))
        for l, counts in total.items():
            out = {"lang": [], "chunk": [], "part": [], "counts": []}
            for k in range(0, n_feat, _CHUNK):
                out["lang"].append(l)
                out["chunk"].append(k // _CHUNK)
                out["part"].append(part)
                out["counts"].append(zlib.compress(counts[k:k + _CHUNK].tobytes(), 1))
            yield record_batch(out, schema)

    def added(tab: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in tab["counts"].to_pylist())
        return pa.table({"lang": tab["lang"][:1], "chunk": tab["chunk"][:1], "part": pa.array([0], pa.int32()),
                         "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())}, schema=schema)

    got = (rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
           .mapInArrow(tidy(count), ddl))
    # Summed in two steps: no group is larger than 64 tasks' chunks or the number of such groups.
    got = got.groupBy("lang", "chunk", F.expr("part div 64")).applyInArrow(added, ddl)
    got = got.groupBy("lang", "chunk").applyInArrow(added, ddl)
    parts: dict[str, dict[int, np.ndarray]] = {}
    for r in got.select("lang", "chunk", "counts").collect():   # the model: languages x features
        parts.setdefault(r["lang"], {})[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    langs = sorted(parts)
    return model_of(langs, np.array([np.concatenate([parts[l][k] for k in sorted(parts[l])]) for l in langs]))


def model_of(langs: list[str], counts: np.ndarray) -> dict:
    if not langs:
        return {"langs": [], "scores": np.zeros((2 * BUCKETS, 0), np.float32), "allowed": np.zeros((len(SCRIPT_NAMES), 0), bool)}
    scores = []
    for part in (counts[:, :BUCKETS], counts[:, BUCKETS:2 * BUCKETS]):
        p = (part + 0.5) / (part.sum(1, keepdims=True) + 0.5 * BUCKETS)
        scores.append(np.log(p) - np.log(p).mean(0))
    by_script = counts[:, 2 * BUCKETS:]
    allowed = by_script >= MIN_SCRIPT * np.maximum(1, by_script.sum(1, keepdims=True))
    allowed &= by_script > 0
    return {"langs": langs, "scores": np.ascontiguousarray(np.concatenate(scores, 1).T / 2, np.float32), "allowed": allowed.T.copy()}


def _pieces(texts: list[str], most: int = 1 << 19):
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if texts:
        yield a, len(texts)


# --------------------------------------------------------------- labelling --

def word_scores(w: Letters, model: dict) -> np.ndarray:
    """Words x languages; a language that the word's script rules out is far below all others."""
    if not len(w.start):
        return np.zeros((0, len(model["langs"])), np.float32)
    bi, tri = w.grams()
    each = model["scores"][bi] + model["scores"][tri]
    e = np.add.reduceat(each, w.bounds[:-1], axis=0)
    allowed = model["allowed"][w.script]
    some = allowed.any(1)
    e[~some] = 0
    e[some[:, None] & ~allowed] -= 1e4
    return e


def viterbi(e: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word; row r has the words first[r]:first[r+1]. All rows step together."""
    n, k = e.shape
    path = np.zeros(n, np.int16)
    counts = np.diff(first)
    if n == 0 or k == 1:
        return path
    order = np.argsort(-counts, kind="stable")
    counts = counts[order]
    order, counts = order[counts > 0], counts[counts > 0]
    at = first[order]
    active = len(counts) - np.searchsorted(counts[::-1], np.arange(counts[0]), "right")   # rows with a word t
    came = np.full((n, k), -1, np.int16)
    v = e[at].astype(np.float64)
    lanes = np.arange(len(order))
    for t in range(1, int(counts[0])):
        m = active[t]
        cur, idx = v[:m], at[:m] + t
        top = cur.argmax(1)
        jump = cur[lanes[:m], top] - switch
        moved = cur < jump[:, None]
        came[idx] = np.where(moved, top[:, None], -1)
        v[:m] = np.where(moved, jump[:, None], cur) + e[idx]
    state = v.argmax(1)
    for t in range(int(counts[0]) - 1, -1, -1):
        m = active[t]
        idx = at[:m] + t
        path[idx] = state[:m]
        back = came[idx, state[:m]]
        state[:m] = np.where(back >= 0, back, state[:m])
    return path


LABEL_DDL = "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def label_texts(texts: list[str | None], model: dict, switch: float = SWITCH) -> dict:
    texts = [t or "" for t in texts]
    langs, parts, scores = model["langs"], [], []
    for a, z in _pieces(texts):
        w = Letters(texts[a:z])
        parts.append((w.start + 0, w.end, w.first, w.offs))
        scores.append(word_scores(w, model))
    if not langs or not parts:
        return {"lang_pred": [UND] * len(texts), "score": [0.0] * len(texts), "spans": [[] for _ in texts]}
    base = np.cumsum([0] + [len(s) for s in scores])
    first = np.concatenate([p[2][:-1] + base[i] for i, p in enumerate(parts)] + [[base[-1]]]).astype(np.int64)
    start = np.concatenate([p[0] - np.repeat(p[3][:-1], np.diff(p[2])) for p in parts])
    end = np.concatenate([p[1] - np.repeat(p[3][:-1], np.diff(p[2])) for p in parts])
    e = np.concatenate(scores)
    path = viterbi(e, first, switch)
    n, k = len(texts), len(langs)
    row = np.repeat(np.arange(n), np.diff(first))
    held = np.bincount(row * k + path, weights=end - start, minlength=n * k).reshape(n, k)
    total = np.zeros((n, k))
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        total[filled] = np.add.reduceat(e, first[filled], axis=0, dtype=np.float64)
    best = np.lexsort((np.broadcast_to(-np.arange(k), (n, k)), total, held), axis=1)[:, -1]
    letters = held.sum(1)
    share = np.where(letters > 0, held[np.arange(n), best] / np.maximum(letters, 1), 0.0)
    turns = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (row[1:] != row[:-1])])) if len(path) else []
    stops = np.concatenate([turns[1:], [len(path)]]) if len(path) else []
    spans: list[list] = [[] for _ in range(n)]
    for x, y in zip(np.asarray(turns, np.int64).tolist(), np.asarray(stops, np.int64).tolist()):
        spans[row[x]].append({"start": int(start[x]), "end": int(end[y - 1]), "lang": langs[path[x]]})
    return {"lang_pred": [langs[b] if c else UND for b, c in zip(best.tolist(), letters.tolist())],
            "score": share, "spans": spans}


def labelled(docs: DataFrame, model: dict, text: str = "text", keep=None, switch: float = SWITCH) -> DataFrame:
    """The ``keep`` columns (all but clashing ones) with lang_pred, score and spans."""
    made = {"lang_pred", "score", "spans"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    src = docs.select(*dict.fromkeys([*keep, text]))
    fields = [src.schema[c] for c in keep] + as_fields(LABEL_DDL)
    schema = arrow_schema(fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            # About 4 letters a word: so many texts that WORDS words are scored at once.
            for a, z in _pieces([t or "" for t in texts], 4 * WORDS):
                got = label_texts(texts[a:z], shared.value, switch)
                rows = b.slice(a, z - a)
                yield record_batch({**{c: rows.column(rows.schema.get_field_index(c)) for c in keep}, **got}, schema)

    return src.mapInArrow(tidy(run), T.StructType(fields))


def is_held_out(doc: str) -> Column:
    """crc32 of the id as text, modulo 3, is 1 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")) % 3 == 1
