"""Python regular expressions for Spark's engine (Java), from Python's own parse.

``to_java`` writes a pattern anew from the tree that Python's ``re`` makes of it, so that both
engines find the same spans: character classes are spelt out (Unicode ``\\d``, ``\\w``, ``\\s``), case
is ignored by listing the characters that Python takes as equal, anchors and word bounds become
look-arounds, a conditional group becomes two branches that ask an empty marker group. What Java
cannot do is refused with a reason (:class:`Refused`); it is never changed silently. Spans of
patterns that can match empty text in several ways are the one thing to ask for: ``spans_differ``.

``required`` gives texts of which every matching line holds at least one, in the form that
:func:`folded` gives a line: the keys by which a search looks up its candidates.

Known limits: a code point that only the newer engine's Unicode version assigns is classed by each
after its own version; deeply nested repeats of groups over very long lines can exceed Java's stack.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _constants as C
    from re import _parser as P
except ImportError:                                  # before Python 3.11
    import sre_constants as C
    import sre_parse as P

_MOST = (1 << 31) - 2
_SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ANY = "(?s:.)"
#: Code points that equal an ASCII letter when case is ignored, besides its own two forms.
_ODD_CASE = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}


class Refused(ValueError):
    """The pattern is valid in Python, but Spark's engine has no equal; the message says why."""


@lru_cache(maxsize=1)
def _cased() -> str:
    """Every code point that has another case."""
    every = (chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    return "".join(c for c in every if c.lower() != c or c.upper() != c or c in "\u0130\u0131")


def _escape(c: int) -> str:
    if 0xD800 <= c <= 0xDFFF:
        raise Refused("a lone surrogate")
    x = chr(c)
    return x if x.isascii() and x.isalnum() else f"\\x{{{c:x}}}"


def _ranges(chars) -> str:
    """A class body of single code points, runs joined."""
    out, codes = [], sorted(map(ord, chars))
    i = 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(_escape(codes[i]) if i == j else f"{_escape(codes[i])}-{_escape(codes[j])}")
        i = j + 1
    return "".join(out)


def _in_python(items) -> str:
    """The same class as a Python pattern, to ask Python what it matches."""
    names = {C.CATEGORY_DIGIT: "\\d", C.CATEGORY_NOT_DIGIT: "\\D", C.CATEGORY_SPACE: "\\s",
             C.CATEGORY_NOT_SPACE: "\\S", C.CATEGORY_WORD: "\\w", C.CATEGORY_NOT_WORD: "\\W"}
    out = []
    for op, av in items:
        if op is C.LITERAL:
            out.append(f"\\U{av:08x}")
        elif op is C.RANGE:
            out.append(f"\\U{av[0]:08x}-\\U{av[1]:08x}")
        else:
            out.append(names[av])
    return "[" + "".join(out) + "]"


class _Writer:
    def __init__(self, tree):
        self.groups: dict[int, int] = {}             # Python's group number -> Java's
        self.markers: dict[int, int] = {}            # ... -> the empty group that says whether it took part
        self.n = 0
        self.asked = set(_asked(tree))

    def word(self, flags) -> str:
        return "[0-9A-Za-z_]" if flags & re.ASCII else "[\\p{L}\\p{N}_]"

    def category(self, av, flags) -> str:
        """Class body."""
        ascii_only = flags & re.ASCII
        plain = {C.CATEGORY_DIGIT: "0-9" if ascii_only else "\\p{Nd}",
                 C.CATEGORY_SPACE: "\\t-\\r\\x20" if ascii_only else _SPACE,
                 C.CATEGORY_WORD: self.word(flags)[1:-1]}
        negated = {C.CATEGORY_NOT_DIGIT: C.CATEGORY_DIGIT, C.CATEGORY_NOT_SPACE: C.CATEGORY_SPACE,
                   C.CATEGORY_NOT_WORD: C.CATEGORY_WORD}
        return plain[av] if av in plain else f"[^{plain[negated[av]]}]"

    def one_of(self, items, flags) -> str:
        items = list(items)
        negated = bool(items) and items[0][0] is C.NEGATE
        items = items[negated:]
        body = []
        for op, av in items:
            if op is C.LITERAL:
                body.append(_escape(av))
            elif op is C.RANGE:
                body.append(f"{_escape(av[0])}-{_escape(av[1])}")
            else:
                body.append(self.category(av, flags))
        if flags & re.IGNORECASE:
            body.append(self.other_case(items, flags))
        same = f"[{''.join(body)}]"
        return f"(?:(?!{same}){_ANY})" if negated else same

    def other_case(self, items, flags) -> str:
        """Class body of what the items match beyond themselves when case is ignored."""
        if all(op is C.LITERAL and av < 128 for op, av in items):
            more = set()
            for _, av in items:
                x = chr(av)
                more |= {x.lower(), x.upper(), *("" if flags & re.ASCII else _ODD_CASE.get(x.lower(), ""))}
            return _ranges(more - {chr(av) for _, av in items})
        source, kind = _in_python(items), re.ASCII if flags & re.ASCII else 0
        return _ranges(set(re.findall(source, _cased(), re.IGNORECASE | kind)) - set(re.findall(source, _cased(), kind)))

    def at(self, av, flags) -> str:
        w = self.word(flags)
        many = flags & re.MULTILINE
        if av is C.AT_BOUNDARY:
            return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
        if av is C.AT_NON_BOUNDARY:                  # never in an empty text
            return f"(?:(?!\\A\\z)(?:(?<={w})(?={w})|(?<!{w})(?!{w})))"
        if av is C.AT_BEGINNING_STRING or av is C.AT_BEGINNING and not many:
            return "\\A"
        if av is C.AT_BEGINNING:
            return "(?:\\A|(?<=\\n))"
        if av is C.AT_END_STRING:
            return "\\z"
        return "(?=\\n|\\z)" if many else "(?=\\n?\\z)"

    def write(self, tree, flags, behind=False) -> str:
        return "".join(self.node(op, av, flags, behind) for op, av in tree)

    def node(self, op, av, flags, behind) -> str:
        if op is C.LITERAL:
            return self.one_of([(op, av)], flags) if flags & re.IGNORECASE else _escape(av)
        if op is C.NOT_LITERAL:
            return self.one_of([(C.NEGATE, None), (C.LITERAL, av)], flags)
        if op is C.IN:
            return self.one_of(av, flags)
        if op is C.ANY:
            return _ANY if flags & re.DOTALL else "[^\\n]"
        if op is C.AT:
            return self.at(av, flags)
        if op is C.BRANCH:
            return "(?:" + "|".join(self.write(b, flags, behind) for b in av[1]) + ")"
        if op is C.SUBPATTERN:
            return self.group(*av, flags, behind)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, getattr(C, "POSSESSIVE_REPEAT", None)):
            lo, hi, body = av
            if lo > _MOST or hi is not C.MAXREPEAT and hi > _MOST:
                raise Refused("a repeat of over 2**31 - 2 times")
            kind = "" if op is C.MAX_REPEAT else "?" if op is C.MIN_REPEAT else "+"
            times = f"{{{lo}}}" if lo == hi else f"{{{lo},{'' if hi is C.MAXREPEAT else hi}}}"
            return f"(?:{self.write(body, flags, behind)}){times}{kind}"
        if op is getattr(C, "ATOMIC_GROUP", None):
            return f"(?>{self.write(av, flags, behind)})"
        if op in (C.ASSERT, C.ASSERT_NOT):
            way, body = av
            sign = ("=" if op is C.ASSERT else "!") if way > 0 else ("<=" if op is C.ASSERT else "<!")
            return f"(?{sign}{self.write(body, flags, behind or way < 0)})"
        if op is getattr(C, "FAILURE", None):
            return "(?!)"
        if op is C.GROUPREF:
            if behind:
                raise Refused("a back reference within a look-behind")
            if flags & re.IGNORECASE:
                return f"(?iu:\\{self.groups[av]})"
            return f"(?:\\{self.groups[av]})"
        if op is C.GROUPREF_EXISTS:
            if behind:
                raise Refused("a conditional group within a look-behind")
            number, yes, no = av
            asked = f"(?:\\{self.markers[number]})" if number in self.markers else None
            if asked is None:
                raise Refused("a conditional group that asks for a group around it or behind it")
            return (f"(?:{asked}{self.write(yes, flags, behind)}"
                    f"|(?!{asked}){self.write(no, flags, behind) if no else ''})")
        raise Refused(f"an element that is not known: {op}")

    def group(self, number, add, drop, body, flags, behind) -> str:
        flags = (flags | add) & ~drop
        if number is None:
            return f"(?:{self.write(body, flags, behind)})"
        self.n += 1
        self.groups[number] = self.n
        out = f"({self.write(body, flags, behind)})"
        if number in self.asked:
            self.n += 1
            self.markers[number] = self.n
            out = f"(?:{out}())"
        return out


def _asked(tree):
    """Numbers of the groups that conditional groups ask for."""
    for op, av in tree:
        if op is C.GROUPREF_EXISTS:
            yield av[0]
        for part in _parts(op, av):
            yield from _asked(part)


def _parts(op, av) -> list:
    if op is C.BRANCH:
        return list(av[1])
    if op is C.SUBPATTERN:
        return [av[3]]
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, getattr(C, "POSSESSIVE_REPEAT", None)):
        return [av[2]]
    if op is getattr(C, "ATOMIC_GROUP", None):
        return [av]
    if op in (C.ASSERT, C.ASSERT_NOT):
        return [av[1]]
    if op is C.GROUPREF_EXISTS:
        return [p for p in av[1:] if p]
    return []


def parse(pattern: str, flags: int = 0):
    """Python's parse of a valid pattern, and its flags; ``re.error`` for one that Python refuses."""
    re.compile(pattern, flags)
    tree = P.parse(pattern, flags)
    return tree, tree.state.flags


def to_java(pattern: str, flags: int = 0) -> str:
    """An equal pattern for Spark's engine; ``re.error`` or :class:`Refused` if there is none."""
    tree, flags = parse(pattern, flags)
    java = _Writer(tree).write(tree, flags)
    # Java also looks for empty matches between the two halves of a code point over U+FFFF.
    return java if tree.getwidth()[0] else f"(?![\\x{{dc00}}-\\x{{dfff}}])(?:{java})"


def spans_differ(pattern: str, flags: int = 0) -> bool:
    """True where an empty match may come first and a longer one at the same place after it: Python
    then gives both, Spark's engine the empty one. Whether a text matches is the same in both."""
    tree, _ = parse(pattern, flags)
    least, most = tree.getwidth()
    return least == 0 and most > 0 and _has_choice(tree)


def _has_choice(tree) -> bool:
    """Anything by which an empty match is tried before the last resort."""
    odd = (C.MIN_REPEAT, C.BRANCH, C.ASSERT, C.ASSERT_NOT, C.AT, C.GROUPREF, C.GROUPREF_EXISTS)
    return any(op in odd or any(map(_has_choice, _parts(op, av))) for op, av in tree)


# ------------------------------------------------------- required literals --

def folded(text: Column) -> Column:
    """A text in lower case, with the characters that Python takes for ASCII letters made such."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))


def required(pattern: str, flags: int = 0) -> list[str]:
    """Folded texts of which every match holds at least one; empty if there is no such set."""
    tree, _ = parse(pattern, flags)
    return sorted(_cover(tree) or [])


def _cover(tree) -> set[str] | None:
    """The best set: the one whose shortest text is longest."""
    sets, run = [], [""]

    def end():
        if run[0]:
            sets.append({run[0]})
        run[0] = ""

    def walk(part):
        for op, av in part:
            if op is C.LITERAL and av < 128:
                run[0] += chr(av).lower()
            elif op is C.SUBPATTERN:
                walk(av[3])
            elif op is getattr(C, "ATOMIC_GROUP", None):
                walk(av)
            elif op is C.AT:
                pass                                 # takes no character
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, getattr(C, "POSSESSIVE_REPEAT", None)) and av[0] >= 1:
                walk(av[2])                          # stands there once at least
                end()
            elif op is C.BRANCH:
                end()
                covers = [_cover(b) for b in av[1]]
                if all(covers):
                    sets.append(set().union(*covers))
            else:
                end()

    walk(tree)
    end()
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=None)
