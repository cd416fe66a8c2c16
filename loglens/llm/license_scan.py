"""License scans: fuzzy search for short notices.

Texts are normalised to lower-case words with one blank between. A notice of ``n`` characters
may be met with ``n // 10`` edits (at most ``MAX_EDITS``; none under ten characters). A notice
is split into one more piece than it may have edits, so any match within the limit holds some
piece unchanged. An automaton finds the pieces of all notices in one walk over the text; only
around them does the regex library match with bounded errors. Matches start and end at words.

Exact places ("base") are counted apart: every place where a base phrase's words stand one after
the other, with its word index.

Defined cases: a null or empty text has no words, no labels and score 0. Rows are judged one by
one by their text, so repeated rows, ids and null ids each give a row. Other columns pass
through; those named like a result give way. Texts are worked off whole, slice by slice.
"""

from __future__ import annotations

import bisect
import heapq
from dataclasses import dataclass

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts
from .textbytes import ALNUM

#: Base phrases and their labels (fixed values of the query's contract).
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Labels of this operator's own: short notices met with errors, besides the base phrases'.
NOTICES = BASE + [
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd license", "bsd"),
    ("isc license", "isc"),
    ("boost software license", "bsl"),
    ("creative commons attribution", "cc-by"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("all rights reserved", "proprietary"),
    ("released into the public domain", "public-domain"),
    ("permission is hereby granted free of charge", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
]
MAX_EDITS = 4
SCAN_DDL = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, "
            "labels array<string>, score double, spans array<struct<label:string,first_word:int,n_words:int,edits:int>>")


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int
    pieces: tuple[tuple[int, str], ...]       # (offset in the phrase, piece)


def notice(phrase: str, label: str) -> Notice:
    n = len(phrase)
    edits = min(MAX_EDITS, n // 10)
    cuts = [round(i * n / (edits + 1)) for i in range(edits + 2)]
    return Notice(phrase, label, edits, tuple((a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])))


class Scanner:
    def __init__(self, base=BASE, notices=NOTICES):
        self.base = [(f" {p} ".encode(), p.count(" ") + 1, label) for p, label in base]
        self.notices = [notice(p, label) for p, label in notices]
        self.automaton = ahocorasick.Automaton()
        by_piece: dict[str, list] = {}
        for i, n in enumerate(self.notices):
            for at, piece in n.pieces:
                by_piece.setdefault(piece, []).append((i, at))
        for piece, where in by_piece.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(r"(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(n.phrase, literal_spaces=True), n.edits),
                                       regex.BESTMATCH) for n in self.notices]

    def exact(self, text: bytes) -> list[tuple[int, int, str]]:
        """(character offset, words, label) of every base place in `` w1 w2 ... ``."""
        out = []
        for phrase, n, label in self.base:
            at = text.find(phrase)
            while at >= 0:
                out.append((at, n, label))
                at = text.find(phrase, at + 1)
        return out

    def fuzzy(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of notices met within their edits, around exact pieces only."""
        windows: dict[int, set[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for i, at in where:
                n = self.notices[i]
                start = end - size + 1 - at
                # One character more on either side, as matches are bounded by blanks.
                windows.setdefault(i, set()).add((max(0, start - n.edits - 1), min(len(text), start + len(n.phrase) + n.edits + 1)))
        return [(m.start(), m.end(), self.notices[i].label, sum(m.fuzzy_counts)) for i, w in windows.items() for m in self._matches(i, text, w)]

    def _matches(self, i: int, text: str, windows):
        """Matches of a notice that do not overlap, those of fewest edits first.

        Each window, little longer than the notice, is searched by itself; one whose match overlaps a better one is
        searched again in what that leaves of it. So the work grows with the number of windows.
        """
        least = len(self.notices[i].phrase) - self.notices[i].edits
        queue, starts, taken = [], [], {}

        def look(a, b):
            if b - a >= least and (m := self.patterns[i].search(text, a, b)):
                heapq.heappush(queue, (sum(m.fuzzy_counts), m.start(), m.end(), a, b, m))

        for a, b in windows:
            look(a, b)
        while queue:
            _, start, end, a, b, m = heapq.heappop(queue)
            at = bisect.bisect_right(starts, start)
            near = [starts[j] for j in (at - 1, at) if 0 <= j < len(starts) and starts[j] < end and taken[starts[j]] > start]
            if not near:
                starts.insert(at, start)
                taken[start] = end
                yield m
                continue
            x, y = min(near), max(taken[s] for s in near)
            look(a, min(b, max(a, x)))
            look(max(a, min(b, y)), b)
            if len(near) > 1:
                look(taken[x], max(near))


def scan_text(scanner: Scanner, norm: bytes) -> dict:
    """The result of one text, given as its words with one blank between."""
    if not norm:
        return {"n_words": 0, "n_base": 0, "first_word": None, "last_word": None, "base_labels": [],
                "labels": [], "score": 0.0, "spans": []}
    padded = b" " + norm + b" "
    hits = scanner.exact(padded)
    text = padded.decode("utf-8", "replace")
    near = scanner.fuzzy(text)
    spans, firsts, score = [], [], 0.0
    if hits or near:
        blanks = [i for i, c in enumerate(padded) if c == 0x20]      # byte offsets of word starts - 1
        points = blanks if len(text) == len(padded) else [i for i, c in enumerate(text) if c == " "]
        for at, n, label in hits:
            first = bisect.bisect_left(blanks, at)
            firsts.append(first)
            spans.append({"label": label, "first_word": first, "n_words": n, "edits": 0})
            score = 1.0
        exact_at = {(s["label"], s["first_word"]) for s in spans}
        for a, b, label, edits in near:
            first = bisect.bisect_left(points, a - 1)
            n = bisect.bisect_left(points, b) - first
            if (label, first) not in exact_at or edits:
                spans.append({"label": label, "first_word": first, "n_words": n, "edits": edits})
                score = max(score, 1.0 - edits / max(1, b - a))
    spans.sort(key=lambda s: (s["first_word"], s["label"], s["n_words"], s["edits"]))
    return {"n_words": norm.count(b" ") + 1, "n_base": len(hits), "first_word": min(firsts, default=None),
            "last_word": max(firsts, default=None), "base_labels": sorted({h[2] for h in hits}),
            "labels": sorted({s["label"] for s in spans}), "score": max(0.0, score), "spans": spans}


def scan(docs: DataFrame, text: str = "text", keep=None, base=BASE, notices=NOTICES) -> DataFrame:
    """``keep`` (all but clashing columns) and n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    made = [f.split()[0] for f in SCAN_DDL.replace("<", " <").split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    table = ALNUM.tobytes()

    def make():
        scanner = Scanner(base, notices)

        def kernel(data, offs, rows):
            norm = data.tobytes().translate(table)
            got = [scan_text(scanner, b" ".join(norm[a:b].split()))
                   for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            return {c: [g[c] for g in got] for c in made}
        return kernel

    return map_texts(docs, text, make, SCAN_DDL, keep)
