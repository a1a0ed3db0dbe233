"""Where a citation can begin: a filter over the first characters of all patterns at once.

For each pattern the classes of characters that its matches can begin with are read
off its parsed form, three characters deep. Characters that no class tells apart are
one symbol, so three symbols in a row are one number, and a table says for each number
which patterns can begin there. A whole batch of texts is looked up in a few numpy operations;
the patterns themselves are then tried at the places that are left, from left to
right and past the end of the match before, which finds what a search of the whole
text finds.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from re import _compiler, _constants, _parser  # type: ignore[attr-defined]

import numpy as np

from citescan.operators import grammar as G

DEPTH = 3
#: characters that are looked up at once
CHUNK = 1 << 20
#: code points with a class of their own; all beyond share one
PLANE = 1 << 16
_ALL = "".join(map(chr, (*range(0xD800), *range(0xE000, PLANE))))
_AT = np.array([*range(0xD800), *range(0xE000, PLANE)])
#: longer or more sets of prefixes than this are cut to shorter ones, which lets more places through
MOST = 4000

Prefix = tuple[int, ...]


class _Prefixes:
    """The beginnings of a pattern's matches as tuples of character classes."""

    def __init__(self) -> None:
        self.classes: dict[tuple, int] = {}
        self.members: list[np.ndarray] = []

    def of_class(self, item: tuple, flags: int) -> int:
        """The number of the class of characters that one item matches."""
        key = (repr(item), flags & re.IGNORECASE)
        if key not in self.classes:
            state = _parser.State()
            state.flags = flags
            one = _compiler.compile(_parser.SubPattern(state, [item]), flags)
            there = np.zeros(PLANE + 1, bool)
            there[_AT[[m.start() for m in one.finditer(_ALL)]]] = True
            there[PLANE] = item[0] is not _constants.LITERAL  # beyond the plane: perhaps
            self.classes[key] = len(self.members)
            self.members.append(there)
        return self.classes[key]

    def joined(self, heads: set[Prefix], tails: set[Prefix]) -> set[Prefix]:
        return {(h + t)[:DEPTH] for h in heads for t in (tails if len(h) < DEPTH else ((),))}

    def of(self, parsed, flags: int) -> set[Prefix]:
        """Prefixes of a sequence; one shorter than ``DEPTH`` may be followed by anything."""
        found: set[Prefix] = {()}
        for item in parsed:
            found = self.joined(found, self.of_item(item, flags))
            if len(found) > MOST:
                found = {p[:-1] for p in found}
                return found
            if all(len(p) == DEPTH for p in found):
                break
        return found

    def of_item(self, item: tuple, flags: int) -> set[Prefix]:
        kind, value = item
        if kind in (_constants.LITERAL, _constants.NOT_LITERAL, _constants.IN, _constants.ANY):
            return {(self.of_class(item, flags),)}
        if kind is _constants.BRANCH:
            return set().union(*(self.of(b, flags) for b in value[1]))
        if kind is _constants.SUBPATTERN:
            _, add, without, inner = value
            return self.of(inner, (flags | add) & ~without)
        if kind in (_constants.MAX_REPEAT, _constants.MIN_REPEAT):
            least, most, inner = value
            once = self.of(inner, flags)
            found: set[Prefix] = set()
            times: set[Prefix] = {()}
            for n in range(min(most, DEPTH) + 1):
                if n:
                    times = self.joined(times, once)
                if n >= min(least, DEPTH):
                    found |= times
            return found
        if kind in (_constants.AT, _constants.ASSERT, _constants.ASSERT_NOT):
            return {()}
        raise ValueError(f"no prefixes of {kind}")


def _opens_at_boundary(parsed) -> bool:
    """Whether all matches begin at a word boundary."""
    for kind, value in parsed:
        if kind is _constants.AT:
            return value is _constants.AT_BOUNDARY
        if kind is _constants.SUBPATTERN and value[1] == value[2] == 0:
            return _opens_at_boundary(value[3])
        if kind not in (_constants.ASSERT, _constants.ASSERT_NOT):
            return False
    return False


class Starts:
    """The filter for some rules of the grammar."""

    def __init__(self, rules: tuple[str, ...]):
        self.patterns = [G.compiled(r) for r in rules]
        prefixes, all_of = _Prefixes(), []
        self.inside = 0  # rules that can begin inside a word
        for i, rule in enumerate(rules):
            parsed = _parser.parse(G.expanded(rule), re.IGNORECASE)
            all_of.append(prefixes.of(parsed, parsed.state.flags))
            self.inside |= 0 if _opens_at_boundary(parsed) else 1 << i
        signs = np.packbits(np.array(prefixes.members), axis=0).T
        _, self.symbol = np.unique(signs, axis=0, return_inverse=True)
        self.symbol = self.symbol.ravel().astype(np.int32)
        n = self.n = int(self.symbol.max()) + 1
        symbols = [np.unique(self.symbol[m]) for m in prefixes.members]
        anything = np.arange(n)
        self.table = np.zeros((n,) * DEPTH, np.uint32)
        for i, found in enumerate(all_of):
            for prefix in found:
                each = [symbols[c] for c in prefix] + [anything] * (DEPTH - len(prefix))
                self.table[np.ix_(*each)] |= np.uint32(1 << i)
        self.table = self.table.ravel()
        self.word = np.zeros(PLANE + 1, np.int8)
        self.word[_AT[[m.start() for m in re.finditer(r"\w", _ALL)]]] = 1
        self.word[PLANE] = 2  # unlike both, so a boundary on either side

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all texts laid end to end, with one character between: where rules can begin, which ones, and where texts begin."""
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        found, which = [np.zeros(0, int)], [np.zeros(0, np.uint32)]
        for lo in range(0, len(points), CHUNK):
            part = np.minimum(points[max(0, lo - 1) : lo + CHUNK + DEPTH - 1], PLANE)
            before, size = min(lo, 1), min(CHUNK, len(points) - lo)
            symbol = np.append(self.symbol[part], np.zeros(DEPTH - 1, self.symbol.dtype))[before:]
            number = symbol[:size]
            for d in range(1, DEPTH):
                number = number * self.n + symbol[d : size + d]
            rules = self.table[number]
            word = self.word[part[: before + size]]
            edge = np.append(word[0] != 0, word[1:] != word[:-1]) | (word == 2)
            edge[1:] |= word[:-1] == 2
            rules = np.where(edge[before:], rules, rules & np.uint32(self.inside))
            at = np.flatnonzero(rules)
            found.append(at + lo)
            which.append(rules[at])
        return np.concatenate(found), np.concatenate(which), np.append(0, np.cumsum([len(t) + 1 for t in texts]))

    def matches(self, texts: list[str]) -> Iterator[list[tuple[int, re.Match[str]]]]:
        """Of each text the matches of all rules: number of the rule and match, the rules by turns, each from left to right."""
        at, rules, starts = self.places(texts)
        bounds = np.searchsorted(at, starts)
        at, rules = at.tolist(), rules.tolist()
        for i, text in enumerate(texts):
            first, found, past = int(starts[i]), [], [0] * len(self.patterns)
            for j in range(bounds[i], bounds[i + 1]):
                place, some = at[j] - first, rules[j]
                while some:
                    r = (some & -some).bit_length() - 1
                    some &= some - 1
                    if place >= past[r] and (m := self.patterns[r].match(text, place)):
                        found.append((r, m))
                        past[r] = m.end()
            yield sorted(found, key=lambda x: x[0])


@functools.cache
def starts(*rules: str) -> Starts:
    return Starts(rules)
