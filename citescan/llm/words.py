"""Words and word shingles of whole Arrow batches as 64-bit hashes, by numpy.

A word is a run of bytes other than space and tab to carriage return, with A-Z
lower-cased. Hashes come from the words' own bytes, so equal words have equal hashes in
every task: a word's bytes are the coefficients of a polynomial, whose value at one
point, modulo the prime 2^61 - 1, is mixed. Two different words of at most n bytes
agree at n of the 2^61 points at most.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
#: bytes that are worked on at once; a segment ends at white space or at a document's end
SEGMENT = 1 << 19
PRIME = (1 << 61) - 1
#: bytes from which on a word is digested as a whole
HUGE = 1 << 22
_BASE = 0x1B873593CC9E2D51 % PRIME
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: each byte's coefficient, the same for A-Z as for a-z
_LETTER = np.arange(1, 257, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_31, _30, _P = U((1 << 31) - 1), U((1 << 30) - 1), U(PRIME)


def _folded(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of numbers below it."""
    ah, al, bh, bl = a >> U(31), a & _31, b >> U(31), b & _31
    mid = ah * bl + al * bh
    return _folded(U(2) * ah * bh + (mid >> U(30)) + ((mid & _30) << U(31)) + al * bl)


_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base modulo the prime."""
    table = _tables.get(base, np.ones(1, U))
    if len(table) < n:
        n = -(-n // (1 << 16)) << 16
        while len(table) < n:
            table = np.concatenate([table, times(table, U(pow(base, len(table), PRIME)))])[:n]
        _tables[base] = table
    return table


class Stretches:
    """Values, modulo the prime, of the polynomials that any stretches of some bytes make, each shorter than ``HUGE``."""

    def __init__(self, data: np.ndarray, base: int, letters: np.ndarray = np.arange(1, 257, dtype=U)):
        up, values = powers(base, len(data) + 1)[: len(data)], letters[data]
        self.down = powers(pow(base, -1, PRIME), len(data) + 1)
        # sums of the powers' lower and upper bits: differences below 2^64 are right even where the sums have wrapped
        self.low, self.high = np.zeros(len(data) + 1, U), np.zeros(len(data) + 1, U)
        np.cumsum(values * (up & _31), out=self.low[1:])
        np.cumsum(values * (up >> U(31)), out=self.high[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        high = self.high[b] - self.high[a]
        value = _folded((high >> U(30)) + ((high & _30) << U(31)) + _folded(self.low[b] - self.low[a]))
        return times(value, self.down[a])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _segment(data: np.ndarray, starts_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word; starts_doc marks the bytes at which a document begins."""
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | starts_doc[1:]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | starts_doc[1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    h = mixed(Stretches(data, _BASE, _LETTER).of(first, last) + (last - first).astype(U) * U(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(last - first >= HUGE):
        folded = (_LETTER[data[first[i] : last[i]]] - U(1)).astype(np.uint8)
        h[i] = int.from_bytes(hashlib.blake2b(folded, digest_size=8).digest(), "little")
    return first, last, h


def words(texts: pa.Array, want_bytes: bool = False) -> tuple[np.ndarray, np.ndarray] | tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and, for each text, where its words begin (one more entry at the end).

    With ``want_bytes`` also each word's first byte and end, the bytes, and the texts'
    places in them. A null text has no words.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(bounds[0]), int(bounds[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    bounds = bounds - lo
    marks = np.zeros(len(data) + 1, bool)
    marks[bounds] = True
    first, last, hashes = [], [], []
    at, end = 0, len(data)
    while at < end:
        stop = min(end, at + SEGMENT)
        if stop < end and not marks[stop]:
            cut = np.flatnonzero(_SPACE[data[at:stop]] | marks[at:stop])
            if len(cut) and cut[-1] > 0:
                stop = at + int(cut[-1])
            else:
                cut = np.flatnonzero(_SPACE[data[stop:]] | marks[stop:end])
                stop = stop + int(cut[0]) if len(cut) else end
        a, b, h = _segment(data[at:stop], marks[at:stop])
        first.append(a + at)
        last.append(b + at)
        hashes.append(h)
        at = stop
    none = np.zeros(0, np.int64)
    starts = np.concatenate(first or [none])
    h = np.concatenate(hashes or [none.astype(U)])
    of_text = np.searchsorted(starts, bounds)
    if not want_bytes:
        return h, of_text
    return h, of_text, starts, np.concatenate(last or [none]), data, bounds


_PLACE = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles of k words of one text, sorted; the whole text where it has fewer words."""
    if len(h) == 0:
        return h
    n = min(k, len(h))
    total = np.full(len(h) - n + 1, U(n))
    for i in range(n):
        total = mixed(total * U(_PLACE[0]) + h[i : len(h) - n + 1 + i])
    return np.unique(total)
