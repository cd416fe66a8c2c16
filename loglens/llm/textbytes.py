"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Both word rules of this subpackage class every code point over 0x7F alike, so they
can be decided byte by byte: each byte of a longer UTF-8 sequence is over 0x7F.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEP = 0x20
MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
MULT_INV = np.uint64(pow(int(MULT), -1, 1 << 64))
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_CHUNK = 1 << 20


def _byte_table(is_word) -> np.ndarray:
    t = np.full(256, SEP, np.uint8)
    for b in range(256):
        if is_word(b):
            t[b] = b + 32 if 0x41 <= b <= 0x5A else b
    return t


#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = _byte_table(lambda b: b > 0x7F or chr(b).isalnum())
#: Words ``[^\x20\x09-\x0D]+`` after lower-casing A-Z.
NONSPACE = _byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up = _powers(MULT, 1 << 12)
    down = _powers(MULT_INV, 1 << 12)

    @classmethod
    def get(cls, n: int):
        if len(cls.up) < n:
            cls.up, cls.down = _powers(MULT, 2 * n), _powers(MULT_INV, 2 * n)
        return cls.up, cls.down


@dataclass
class Words:
    """Words of a slice: ``norm`` holds the normalised bytes, word i is norm[start[i]:end[i]]."""

    norm: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray      # first[r] is the index of row r's first word; one more entry than rows

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word: a polynomial of its bytes and length, mixed.

        Worked off in runs of about a megabyte, so memory follows the run.
        """
        out = np.empty(len(self.start), np.uint64)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + _CHUNK)))
            lo, hi = int(self.start[a]), int(self.end[b - 1])
            up, down = _Powers.get(hi - lo)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(self.norm[lo:hi].astype(np.uint64) * up[:hi - lo], out=total[1:])
            s, e = self.start[a:b] - lo, self.end[a:b] - lo
            out[a:b] = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            a = b
        return out

    def text(self, i: int, n: int) -> bytes:
        """Words i to i+n-1, with one blank between."""
        return b" ".join(self.norm[s:e].tobytes() for s, e in zip(self.start[i:i + n], self.end[i:i + n]))


def words(data: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> Words:
    norm = classes[data]
    mask = norm != SEP
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    ends[:-1] &= ~mask[1:]
    if len(data):
        at = offs[:-1][offs[:-1] < offs[1:]]        # a word never runs on into the next text
        begins[at] = mask[at]
        last = offs[1:][offs[:-1] < offs[1:]] - 1
        ends[last] = mask[last]
    start = np.flatnonzero(begins)
    return Words(norm, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offs))


def window_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (also over the ends of texts: see ``inside``)."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = word_hash[:m].copy()
    for j in range(1, n):
        acc *= STEP
        acc += word_hash[j:m + j]
    return mixed(acc + np.uint64(n))


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which windows of ``n`` words lie within one text."""
    ok = np.zeros(max(0, total - n + 1), bool)
    counts = np.diff(first)
    for_rows = np.flatnonzero(counts >= n)
    if len(for_rows) == 0:
        return ok
    step = np.zeros(len(ok) + 1, np.int32)
    np.add.at(step, first[for_rows], 1)
    np.add.at(step, first[for_rows] + counts[for_rows] - n + 1, -1)
    return np.cumsum(step[:-1]) > 0
