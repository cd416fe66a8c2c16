"""Plain single-machine versions of the operators, for comparison on small inputs."""

import re

UP = {c: c + 32 for c in range(65, 91)}
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").translate(UP))


def jaccard_components(rows, k=5, percent=80):
    """{id: smallest id reachable}, [(id, set size)] by all pairs."""
    sets, sizes = {}, []
    for d, t in rows:
        w = words(t, SPACED)
        s = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sizes.append((d, len(s)))
        if d is not None:
            sets.setdefault(d, []).append(s)
    ids, root = list(sets), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}, sizes


def line_dedup(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    low = lambda d: (d is not None, d or 0)
    keeper = {k: max(v, key=low) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def decontaminate(rows, items, n=10):
    windows = {}
    for item, t in items:
        w = words(t)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + m]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (got := windows.get(tuple(w[i:i + m]))):
                    hit.update(range(i, i + m))
                    ids |= got
        out.append((d, len(w), len(hit), sorted(ids)))
    return out
