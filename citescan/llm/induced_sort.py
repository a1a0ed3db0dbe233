"""Induced sorting of the suffixes of a shard on disk, with common-prefix values.

Suffixes that start an S-type run (LMS suffixes) are sorted first: one pass of
induction sorts the substrings between them and names them, and the string of
names is settled by doubling, up to the depth asked for. Then two passes of
induction sort all suffixes. A pass takes tuples (suffix, common prefix with the
tuple before) from a queue by first byte, in order, and puts the tuple of the
preceding suffix into the queue of its own first byte; the common prefix of two
tuples that meet there is one more than the least value passed since.

The queue holds blocks of tuples and moves them to a file beyond a limit of
memory. Arrays of the shard's length are files as well where they are long, mapped
into memory, so a shard can be far larger than the memory of a task.
"""

from __future__ import annotations

import tempfile
from collections import deque

import numpy as np

#: tuples that are worked on at once
BLOCK = 1 << 16
#: tuples of a queue that stay in memory
QUEUED = 1 << 21
#: bytes of an array that stays in memory; a longer one is a file
IN_MEMORY = 24 << 20
#: byte that ends each piece of a shard's text; the bytes of UTF-8 move up by one
END = 0


class Disk:
    """Arrays in temporary files of the task, gone when it ends."""

    def __init__(self) -> None:
        self.folder = tempfile.TemporaryDirectory(prefix="shard-")
        self.count = 0

    def empty(self, n: int, kind: type | str) -> np.ndarray:
        self.count += 1
        if n * np.dtype(kind).itemsize <= IN_MEMORY:
            return np.zeros(n, kind)
        return np.memmap(f"{self.folder.name}/{self.count}", dtype=kind, mode="w+", shape=(n,))

    def close(self) -> None:
        self.folder.cleanup()


class Queue:
    """Blocks of (suffix, common prefix) by first byte, first in, first out."""

    def __init__(self) -> None:
        self.blocks: list[deque] = [deque() for _ in range(256)]
        self.held = 0
        self.file = None

    def push(self, byte: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        if self.held + len(suffixes) > QUEUED:
            self.file = self.file or tempfile.TemporaryFile(prefix="queue-")
            at = self.file.seek(0, 2)
            self.file.write(suffixes.astype(np.int64).tobytes())
            self.file.write(common.astype(np.uint16).tobytes())
            self.blocks[byte].append((at, len(suffixes)))
            return
        self.held += len(suffixes)
        self.blocks[byte].append((suffixes, common))

    def pop(self, byte: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next block, of several small ones put together."""
        some: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        while self.blocks[byte] and size < BLOCK:
            a, b = self.blocks[byte].popleft()
            if isinstance(a, int):
                self.file.seek(a)
                a, b = np.frombuffer(self.file.read(8 * b), np.int64), np.frombuffer(self.file.read(2 * b), np.uint16)
            else:
                self.held -= len(a)
            some.append((a, b))
            size += len(a)
        if not some:
            return None
        return np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some])


def _least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a:b+1] for each pair a <= b."""
    if not len(a):
        return np.zeros(0, values.dtype)
    level = np.zeros(len(values) + 1, np.int64)
    level[1:] = np.floor(np.log2(np.arange(1, len(values) + 1)))
    k = level[b - a + 1]
    out = np.empty(len(a), values.dtype)
    table = values
    for step in range(int(k.max()) + 1):
        if step:
            half = 1 << (step - 1)
            table = np.minimum(table[:-half], table[half:])
        at = np.flatnonzero(k == step)
        if len(at):
            out[at] = np.minimum(table[a[at]], table[b[at] - (1 << step) + 1])
    return out


def induce(text: np.ndarray, wanted: np.ndarray, runs: np.ndarray, seeds, depth: int, emit, flip: bool) -> None:
    """One pass of induction.

    ``wanted`` marks the suffixes to sort. ``seeds(byte)`` yields blocks of sorted
    suffixes that follow the induced ones of a byte, with the common prefix of each
    with the one before it. ``emit(byte, suffixes, common)`` gets the induced ones in
    order. With ``flip`` bytes and suffixes go from the largest to the smallest.
    """
    queue = Queue()
    since = np.full(256, depth, np.uint16)  # least value since the last push, by byte
    fresh = np.ones(256, bool)

    def step(suffixes: np.ndarray, common: np.ndarray) -> None:
        before = suffixes - 1
        at = np.flatnonzero(suffixes > 0)
        at = at[wanted[before[at]]]
        byte = text[before[at]]
        order = np.argsort(byte, kind="stable")
        at, byte = at[order], byte[order]
        total = common.min() if len(common) else depth
        if len(at):
            first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
            rest = np.ones(len(at), bool)
            rest[first] = False
            value = np.empty(len(at), np.uint16)
            inner = np.flatnonzero(rest)
            value[inner] = _least_between(common, at[inner - 1] + 1, at[inner])
            value[first] = np.minimum(since[byte[first]], np.minimum.accumulate(common)[at[first]])
            value = np.minimum(value + 1, depth).astype(np.uint16)
            value[first[fresh[byte[first]]]] = 0
            np.minimum(since, total, out=since)
            after = np.append(np.minimum.accumulate(common[::-1])[::-1], depth)
            ends = np.append(first[1:], len(at))
            for a, b in zip(first.tolist(), ends.tolist(), strict=True):
                c = int(byte[a])
                queue.push(c, before[at[a:b]], value[a:b])
                fresh[c] = False
                since[c] = after[at[b - 1] + 1]
        else:
            np.minimum(since, total, out=since)

    for c in reversed(range(256)) if flip else range(256):
        last = None
        while (block := queue.pop(c)) is not None:
            emit(c, *block)
            last = block[0][-1]
            step(*block)
        for suffixes, common in seeds(c):
            if not len(suffixes):
                continue
            common = common.copy()
            if last is not None and last >= 0:
                common[0] = min(int(runs[last]), int(runs[suffixes[0]]), depth)
                last = -1
            elif last is None:
                common[0] = 0
                last = -1
            step(suffixes, common)


def _types(text: np.ndarray, disk: Disk) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is S-type (smaller than the next), and how often its first byte repeats."""
    n = len(text)
    s_type, runs = disk.empty(n, bool), disk.empty(n, np.int32)
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    rises = np.ones(len(change), bool)
    rises[:-1] = text[change[:-1]] < text[change[:-1] + 1]
    lengths = np.diff(change, prepend=-1)
    for a in range(0, len(change), 1 << 20):
        b = min(len(change), a + (1 << 20))
        lo, hi = int(change[a - 1]) + 1 if a else 0, int(change[b - 1]) + 1
        s_type[lo:hi] = np.repeat(rises[a:b], lengths[a:b])
        runs[lo:hi] = np.repeat(change[a:b], lengths[a:b]) - np.arange(lo, hi) + 1
    return s_type, runs


class Blocks:
    """Sorted suffixes by byte, on disk, for the next pass to read."""

    def __init__(self, n: int, disk: Disk) -> None:
        self.suffix, self.common = disk.empty(n, np.int64), disk.empty(n, np.uint16)
        self.at, self.spans = 0, {}

    def emit(self, byte: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        a, b = self.at, self.at + len(suffixes)
        self.suffix[a:b], self.common[a:b] = suffixes, common
        self.spans[byte] = (self.spans.get(byte, (a, b))[0], b)
        self.at = b

    def backwards(self, byte: int):
        """From the largest to the smallest, with the common prefix with the larger neighbour."""
        a, b = self.spans.get(byte, (0, 0))
        for hi in range(b, a, -BLOCK):
            lo = max(a, hi - BLOCK)
            common = np.zeros(hi - lo, np.uint16)
            common[1:] = self.common[lo + 1 : hi][::-1]
            if hi < b:
                common[0] = self.common[hi]
            yield self.suffix[lo:hi][::-1], common


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    found, names = np.unique(keys, return_inverse=True)
    return names.astype(np.int32), len(found)


def _lms_order(text: np.ndarray, s_type: np.ndarray, runs: np.ndarray, lms: np.ndarray, depth: int, disk: Disk) -> tuple[np.ndarray, np.ndarray]:
    """LMS suffixes in order, and the common prefix of each with the one before, to ``depth``."""
    m = len(lms)
    by_byte = lms[np.argsort(text[lms], kind="stable")]
    cut = np.searchsorted(text[by_byte], np.arange(257))
    none = lambda x: np.zeros(len(x), np.uint16)

    def unsorted(c: int):
        for a in range(cut[c], cut[c + 1], BLOCK):
            part = by_byte[a : min(a + BLOCK, cut[c + 1])]
            yield part, none(part)

    larger = Blocks(len(text), disk)
    induce(text, ~s_type, runs, unsorted, 1, larger.emit, False)
    is_lms = disk.empty(len(text), bool)
    is_lms[lms] = True
    found: list[np.ndarray] = []
    induce(text, s_type, runs, larger.backwards, 1, lambda c, s, _: found.append(s[is_lms[s]]), True)
    order = np.concatenate([lms[-1:], np.concatenate([np.zeros(0, np.int64), *found])[::-1]])
    # names: equal substrings from one LMS suffix to the next have equal lengths and bytes
    following = np.append(lms[1:], len(text) - 1)
    index = np.searchsorted(lms, order)
    length = following[index] - order + 1
    same = length[1:] == length[:-1]
    for k in range(int(length[1:][same].max()) if same.any() else 0):
        live = np.flatnonzero(same & (length[1:] > k))
        if not len(live):
            break
        same[live] = text[order[1:][live] + k] == text[order[:-1][live] + k]
    rank = np.empty(m, np.int32)
    rank[index] = np.append(0, np.cumsum(~same))
    # the string of names, by doubling until each name covers the depth
    levels, step, names = [rank], 1, int(rank.max()) + 1
    span = lambda k: np.where(np.arange(m) + k < m, lms[np.minimum(np.arange(m) + k, m - 1)] - lms, depth)
    while names < m and int(span(step).min()) < depth:
        ahead = np.zeros(m, np.int64)
        ahead[:-step or None] = rank[step:] + 1 if step < m else 0
        rank, names = _dense(rank.astype(np.int64) * (m + 1) + ahead)
        level = disk.empty(m, np.int32)
        level[:] = rank
        levels.append(level)
        step *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        level, jump = levels[k], 1 << k
        fits = (a + jump < m) & (b + jump < m)
        equal = np.flatnonzero(fits & (level[np.minimum(a, m - 1)] == level[np.minimum(b, m - 1)]))
        shared[equal] += lms[a[equal] + jump] - lms[a[equal]]
        a[equal] += jump
        b[equal] += jump
    # what is left is within one substring, or at the text's end
    x, y = lms[a], lms[b]
    live = np.flatnonzero(shared < depth)
    k = np.zeros(len(x), np.int64)
    while len(live):
        live = live[np.maximum(x[live], y[live]) + k[live] < len(text)]
        live = live[text[x[live] + k[live]] == text[y[live] + k[live]]]
        k[live] += 1
        live = live[shared[live] + k[live] < depth]
    return lms[order], np.append(0, np.minimum(shared + k, depth)).astype(np.uint16)


def repeated(text: np.ndarray, depth: int) -> np.ndarray:
    """Whether the ``depth`` bytes from each position also start elsewhere in text, whose last byte is END."""
    disk = Disk()
    try:
        return _repeated(text, depth, disk)
    finally:
        disk.close()


def _repeated(text: np.ndarray, depth: int, disk: Disk) -> np.ndarray:
    n = len(text)
    out = np.zeros(n, bool)
    if n <= depth:
        return out
    s_type, runs = _types(text, disk)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if not len(lms):  # one falling run: no two suffixes share more than their first bytes
        at = np.flatnonzero(runs > depth)
        out[at] = True
        out[at + 1] = True
        return out
    order, common = _lms_order(text, s_type, runs, lms, depth, disk)
    cut = np.searchsorted(text[order], np.arange(257))

    def sorted_lms(c: int):
        for a in range(cut[c], cut[c + 1], BLOCK):
            b = min(a + BLOCK, cut[c + 1])
            yield order[a:b], common[a:b]

    ends = np.full((256, 2), -1, np.int64)  # the largest L-type and the smallest S-type suffix of each byte
    last = {"at": -1}

    def mark(c: int, suffixes: np.ndarray, values: np.ndarray) -> None:
        deep = values >= depth
        out[suffixes[deep]] = True
        out[suffixes[:-1][deep[1:]]] = True
        if deep[0] and last["at"] >= 0:
            out[last["at"]] = True
        last["at"] = int(suffixes[-1])

    larger = Blocks(n, disk)

    def keep_larger(c: int, suffixes: np.ndarray, values: np.ndarray) -> None:
        larger.emit(c, suffixes, values)
        mark(c, suffixes, values)
        ends[c, 0] = suffixes[-1]

    def smaller(c: int, suffixes: np.ndarray, values: np.ndarray) -> None:
        mark(c, suffixes, values)
        ends[c, 1] = suffixes[-1]

    induce(text, ~s_type, runs, sorted_lms, depth, keep_larger, False)
    last["at"] = -1
    induce(text, s_type, runs, larger.backwards, depth, smaller, True)
    for a, b in ends.tolist():
        if a >= 0 and b >= 0 and min(runs[a], runs[b]) >= depth:
            out[[a, b]] = True
    return out
