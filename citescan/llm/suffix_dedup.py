"""Removal of repeated passages by suffix arrays of shards.

A string of ``length`` bytes that starts in two places looks the same from inside,
so both places choose the same anchor in it: the least hash of its 32-byte pieces.
Starts of a document that share an anchor form a segment, a few hundred bytes
long. Equal segments are one class, and all starts of a class with two members are
repeated; what is left to settle are single segments whose anchor other classes
have too, or which have it twice. Those classes go to shards by anchor, one copy of each, and a shard's
suffixes are sorted by external induction, with common prefixes: a start is
repeated where its suffix shares ``length`` bytes with a neighbour.

An anchor with more text than a part of a shard is not sorted but cut further on
Spark. Equal strings have their first anchor at one distance from their start;
starts of like distance (``NEAR``) form a block, whose strings share a core, all but
a few bytes of them. Blocks whose core nothing else has are settled; the strings of
the others are counted one by one, by 128 bits. So no shard grows with an anchor.

So passages that thousands of documents hold cost one class each, and the sorted
text is that of the places where copies begin to differ.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescan.llm import words as W
from citescan.llm.induced_sort import END, repeated
from citescan.llm.sieve import sieved
from citescan.session import keep

#: bytes of an anchor
PIECE = 32
#: starts of a document that are worked on at once
PART = 1 << 20
#: bytes of a shard, in the mean; an anchor with more than a quarter of them is cut further
SHARD = 3 << 20
#: distances from the anchor that make one block
NEAR = 16


#: points at which the two hashes of a stretch are taken
BASES = (0x0A2F9836E4E44152, 0x19FDA3B5C7E10F4D)


class _Prefix:
    """Hashes of any stretch of some bytes; the two that ``which`` names are independent."""

    def __init__(self, data: np.ndarray, which: int):
        self.stretches = W.Stretches(data, BASES[which - 1])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return W.mixed(self.stretches.of(a, b) + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    table, span = h, 1
    while span * 2 <= width:
        table = np.minimum(table[:-span], table[span:])
        span *= 2
    n = len(h) - width + 1
    return np.minimum(table[:n], table[width - span : width - span + n])


def _again(h: np.ndarray, least: np.ndarray, s: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether a segment's anchor, the least of h at s and later, is there more than once before ``stop``."""
    names, mine = np.unique(least[s], return_inverse=True)
    low = np.flatnonzero(h <= names[-1])
    name = np.minimum(np.searchsorted(names, h[low]), len(names) - 1)
    fits = names[name] == h[low]
    places = np.sort(name[fits] * (len(h) + 1) + low[fits])
    second = np.searchsorted(places, mine * (len(h) + 1) + s) + 1
    return (second < len(places)) & (places[np.minimum(second, len(places) - 1)] < mine * (len(h) + 1) + stop)


def segments(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """anchor, two hashes, first start and end of the starts, and whether the anchor is there twice, of the segments of some bytes."""
    for lo in range(0, len(data) - length + 1, PART):
        part = data[lo : lo + PART + length - 1]
        one, two = _Prefix(part, 1), _Prefix(part, 2)
        at = np.arange(len(part) - PIECE + 1)
        h = one.of(at, at + PIECE)
        least = _least(h, length - PIECE + 1)
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        s, e = np.append(0, cut), np.append(cut, len(least))
        stop = e + length - 1
        twice = _again(h, least, s, stop - PIECE + 1)
        yield tuple(x.astype(np.int64) for x in (least[s], one.of(s, stop), two.of(s, stop), s + lo, e + lo, twice))


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _segments_of(texts: DataFrame, length: int) -> DataFrame:
    names = ["rid", "anchor", "ka", "kb", "s", "e", "twice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            held = 0
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(_bytes(text), np.uint8)
                for x in segments(data, length) if len(data) >= length else ():
                    found.append((np.full(len(x[0]), rid), *x))
                    held += len(x[0])
                if held > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)
                    found, held = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

    return texts.select("rid", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, wanted pieces → anchor, ka, kb, number of starts, the piece's bytes."""
    long = pa.int64()
    kinds = (long, long, long, long, pa.binary())
    for batch in batches:
        rows: list[tuple] = []
        for text, pieces in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            data = _bytes(text)
            rows += [(p["anchor"], p["ka"], p["kb"], p["e"] - p["s"], data[p["s"] : p["stop"]]) for p in pieces]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["anchor", "ka", "kb", "starts", "piece"]
            )


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _sort_shard(length: int):
    shift = bytes(min(b + 1, 255) for b in range(256))  # UTF-8 has no byte 0xFF

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, ka, kb, starts = bytearray(), [], [], []
        at: list[int] = []
        for batch in batches:
            ka += batch.column(1).to_pylist()
            kb += batch.column(2).to_pylist()
            starts += batch.column(3).to_pylist()
            for x in batch.column(4):
                at.append(len(pieces))
                pieces += _bytes(x).translate(shift)
                pieces.append(END)
        if not at:
            return
        flags = repeated(np.frombuffer(pieces, np.uint8), length)
        for i in range(0, len(at), 10_000):
            some = range(i, min(i + 10_000, len(at)))
            found = [(ka[k], kb[k], r) for k in some if (r := _runs(flags[at[k] : at[k] + starts[k]]))]
            if found:
                a, b, r = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(r, _RUNS)], names=["ka", "kb", "runs"])

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose last column, the pieces' bytes, is about PART long, or one piece."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy())
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + PART, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _joined(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the pieces of a part, one after the other, and where each begins, with the end."""
    pieces = [_bytes(x) for x in part.column(part.num_columns - 1)]
    return np.frombuffer(b"".join(pieces), np.uint8), np.append(0, np.cumsum([len(x) for x in pieces])).astype(np.int64)


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range."""
    return np.repeat(first - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())


def _cores(length: int):
    """anchor, ka, kb, starts, piece → ka, kb, first and last start of each block, and two hashes of its core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            anchor = part.column(0).to_numpy().astype(np.uint64)
            ka, kb, starts = (part.column(i).to_numpy() for i in (1, 2, 3))
            data, edge = _joined(part)
            one, two = _Prefix(data, 1), _Prefix(data, 2)
            at = np.arange(len(data) - PIECE + 1)
            of = np.searchsorted(edge, at, side="right") - 1
            places = at[(one.of(at, at + PIECE) == anchor[of]) & (at + PIECE <= edge[of + 1])]
            s, row = _ranges(edge[:-1], starts), np.repeat(np.arange(len(starts)), starts)
            place = places[np.searchsorted(places, s)]
            block = (place - s) // NEAR
            new = np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1]) | (block[1:] != block[:-1]))
            i = np.flatnonzero(new)
            last = s[np.append(i[1:], len(s)) - 1]
            row, block = row[i], block[i]
            lo = place[i] - block * NEAR
            hi = lo - NEAR + 1 + length
            ca, cb = (W.mixed(x.of(lo, hi) + block.astype(np.uint64)).astype(np.int64) for x in (one, two))
            columns = (ka[row], kb[row], s[i] - edge[row], last - edge[row], ca, cb)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ka", "kb", "first", "last", "ca", "cb"])

    return run


def _strings(length: int):
    """ka, kb, blocks, piece → ka, kb, start and two hashes of each string of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            ka, kb = (part.column(i).to_numpy() for i in (0, 1))
            blocks = part.column(2)
            row = pc.list_parent_indices(blocks).to_numpy()
            each = blocks.flatten()
            first, last = (each.field(i).to_numpy() for i in (0, 1))
            data, edge = _joined(part)
            one, two = _Prefix(data, 1), _Prefix(data, 2)
            s, row = _ranges(first, last - first + 1), np.repeat(row, last - first + 1)
            a = s + edge[row]
            wa, wb = (x.of(a, a + length).astype(np.int64) for x in (one, two))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ka[row], kb[row], s, wa, wb)], names=["ka", "kb", "s", "wa", "wb"])

    return run


def _as_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = []
        for starts in batch.column(2).to_pylist():
            flags = np.zeros(max(starts) + 1, bool)
            flags[starts] = True
            runs.append(_runs(flags))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, _RUNS)], names=["ka", "kb", "runs"])


def _counted(cut: DataFrame, length: int) -> DataFrame:
    """ka, kb, runs of the repeated starts of pieces (anchor, ka, kb, starts, piece) that have all pieces of their anchors."""
    pieces = keep(cut, "large-anchors", compression="zstd")
    cores = pieces.mapInArrow(_cores(length), "ka long, kb long, first long, last long, ca long, cb long")
    shared = keep(cores.groupBy("ca", "cb").agg(F.count("*").alias("n")).filter("n > 1").select("ca", "cb"), "cores")
    blocks = cores.join(shared, ["ca", "cb"], "left_semi").groupBy("ka", "kb").agg(F.collect_list(F.struct("first", "last")).alias("blocks"))
    live = keep(pieces.join(blocks, ["ka", "kb"]).select("ka", "kb", "blocks", "piece"), "blocks", compression="zstd")
    strings = live.mapInArrow(_strings(length), "ka long, kb long, s long, wa long, wb long")
    again = keep(strings.groupBy("wa", "wb").agg(F.count("*").alias("n")).filter("n > 1").select("wa", "wb"), "strings")
    starts = strings.join(again, ["wa", "wb"], "left_semi").groupBy("ka", "kb").agg(F.collect_list("s").alias("starts"))
    return starts.mapInArrow(_as_runs, "ka long, kb long, runs array<struct<first:long,last:long>>")


def _cleaned(length: int, with_text: bool):
    """doc_id, text, runs of repeated starts → what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
            for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = _bytes(text)
                spans: list[list[int]] = []
                for r in sorted(runs or (), key=lambda r: r["first"]):
                    a, b = r["first"], r["last"] + length
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                edges = [0, *(x for s in spans for x in s), len(data)]
                left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(left))
                n_spans.append(len(spans))
                sha.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept.append(left.decode("utf-8", "ignore"))
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept, pa.string())], [*names, "text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def without_repeats(docs: DataFrame, length: int = 400, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the text that is left: one row per row of ``docs``.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else,
    in the same document or another one, goes; all copies go, the first included. A
    null text is empty. Repeated rows are copies of each other; doc_id, null or
    repeated, plays no part. The text that is left drops what is no whole character,
    its hash is of the bytes. Other columns are ignored; an empty table gives an
    empty result. ``length`` is at least 64.
    """
    if length < 2 * PIECE:
        raise ValueError(f"length: at least {2 * PIECE}")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = keep(rows, "texts", compression="zstd")
    each = keep(_segments_of(texts, length), "segments")
    classes = each.groupBy("anchor", "ka", "kb").agg(F.count("*").alias("n"), F.min(F.struct("rid", "s", "e", "twice")).alias("one"))
    classes = keep(classes.select("anchor", "ka", "kb", "n", "one.*"), "classes")
    unsettled = classes.groupBy("anchor").agg(F.count("*").alias("m"), F.sum((F.col("n") == 1).cast("long")).alias("single"), F.max("twice").alias("twice"), F.sum(F.col("e") - F.col("s") + length - 1).alias("b"))
    unsettled = unsettled.filter("(m > 1 or twice > 0) and single > 0").select("anchor", (F.col("b") > SHARD // 4).alias("large"))
    piece = F.struct("anchor", "ka", "kb", "s", "e", (F.col("e") + length - 1).alias("stop"))
    wanted = classes.join(unsettled, "anchor").select("rid", "large", piece.alias("p"))
    wanted = keep(wanted.groupBy("large", "rid").agg(F.collect_list("p").alias("pieces")), "wanted")

    def cut(some: DataFrame) -> DataFrame:
        held = sieved(texts.select("rid", "text"), F.col("rid"), some.select("rid"))
        return held.join(some.select("rid", "pieces"), "rid").select("text", "pieces").mapInArrow(_cut, "anchor long, ka long, kb long, starts long, piece binary")

    size = wanted.select("large", F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["stop"] - p["s"]).alias("b")).groupBy("large").agg(F.sum("b"))
    sizes = {r[0]: r[1] for r in size.collect()}
    shards = cut(wanted.filter("not large")).repartition(max(1, math.ceil(sizes.get(False, 0) / SHARD)), "anchor")
    runs = "array<struct<first:long,last:long>>"
    sorted_ = shards.mapInArrow(_sort_shard(length), f"ka long, kb long, runs {runs}")
    if sizes.get(True):
        sorted_ = sorted_.union(_counted(cut(wanted.filter("large")), length))
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("e") - F.col("s") - 1).alias("last")))
    copied = classes.filter("n > 1").select("ka", "kb", all_of.alias("runs"))
    single = classes.filter("n = 1").select("ka", "kb")
    found = keep(copied.union(sorted_.join(single, ["ka", "kb"], "left_semi")), "found")
    spans = each.select("rid", "s", "ka", "kb").join(found, ["ka", "kb"])
    spans = spans.select("rid", F.transform("runs", lambda r: F.struct((r["first"] + F.col("s")).alias("first"), (r["last"] + F.col("s")).alias("last"))).alias("runs"))
    spans = spans.groupBy("rid").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text
    return texts.join(spans, "rid", "left").select("doc_id", "text", "runs").mapInArrow(_cleaned(length, with_text), out)
