"""N-gram Jaccard self-join of documents with a token-group matrix.

A document is the set of its word shingles, as 64-bit tokens; equal sets become one
node. Signatures say which sets can link, exactly: sets are classed by size, and the
token space is cut into more ranges than two linked sets of a class can have tokens
apart, so linked sets agree in at least ``SPARE`` whole ranges. A signature is the
content of one range, or of three empty ones; linked sets share two of them or more.
Large sets have an eighth of ranges to spare, so that two shared ones stand in one band of
``BAND`` ranges: where signatures are so common that they count in pairs only, the pairs of a band are enough.

The matrix: nodes are partitioned into groups of similar ones, by the signature of
theirs that most nodes share, and large groups are cut by hash to ``BLOCK`` tokens.
A node is put to the groups with which it has two signatures in common itself. One task holds a
group's members and the union of their tokens; nodes of other groups come
past as queries. A query whose overlap with the union does not reach what a link
needs is done with; for the others the group is opened and all members are compared.
Every pair of linked nodes is found in this way, within a group or by both queries.

No pair of nodes leaves a task: each node has the number of its links and one edge
to the least node that it is connected with there. Components come from the edges.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citescan.llm import words as W
from citescan.llm.names import free
from citescan.llm.sieve import sieved
from citescan.session import drop, keep

#: whole ranges that linked sets share at least: enough for two signatures even where empty ranges count in triples
SPARE = 4
#: ranges from which on empty ones are left out
MANY = 64
#: neighbouring ranges in which two linked sets of many share two
BAND = 16
#: groups from which on a signature counts only together with another one
COMMON = 256
#: passes in which signatures meet, so that the disk holds a pass's part of them beside the sets
SLICES = 4
#: ratio of the largest to the smallest set of a class
STEP = 1.25
#: tokens of a group, in the mean
BLOCK = 1 << 18
#: tokens that a smaller set counts as
LIGHT = 512
#: blocks of queries that one task puts to a group
QUERIES = 8
#: tokens that are compared at once
COLUMNS = 2048


@functools.cache
def size_classes(limit: int) -> list[int]:
    """The first set size of each class, up to the class that holds ``limit``."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, math.floor(out[-1] * STEP)))
    return out


def apart(similarity: int, size: int) -> int:
    """Tokens that are in one only of two linked sets of at most ``size`` tokens, at most."""
    return 2 * size * (100 - similarity) // (100 + similarity)


@functools.lru_cache(maxsize=4096)
def _edges(ranges: int) -> np.ndarray:
    """Where each of so many equal ranges of the 64-bit numbers begins."""
    return np.array([-(-(j << 64) // ranges) for j in range(ranges)], dtype=np.uint64)


def signatures(tokens: np.ndarray, similarity: int) -> list[np.ndarray]:
    """Signatures for the set's own class and for each larger one in which a linked set can be, in bands of those that can meet in pairs.

    A range that holds tokens has a signature of its own, three empty ones have one
    together. So two linked sets share two signatures at least: of four ranges in
    common two, or one and the triple of the others, or all triples. From ``MANY``
    ranges on empty ones are left out: that two linked sets share fewer than two that
    are not, as the tokens' places are random, has a chance below 2^-64.
    """
    n, out = len(tokens), []
    starts = size_classes(1 << max(10, (2 * n).bit_length()))
    own = int(np.searchsorted(starts, n, side="right")) - 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(W.mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    for c in range(own, len(starts) - 1):
        if c > own and 100 * n < similarity * starts[c]:
            break
        differ = apart(similarity, starts[c + 1] - 1)
        ranges = differ + SPARE if differ else 1
        if ranges >= MANY:
            ranges = differ + max(SPARE, -(-differ // 7))
        cut = np.append(np.searchsorted(tokens, _edges(ranges)), n)
        salt = np.uint64(c << 40) + np.arange(ranges, dtype=np.uint64)
        each = W.mixed(W.mixed(salt) + (total[cut[1:]] - total[cut[:-1]]) * np.uint64(0x2545F4914F6CDD1D))
        if ranges >= MANY:
            full = cut[1:] > cut[:-1]
            bands = (np.split(x, range(BAND, ranges, BAND)) for x in (each, full))
            out += [e[f] for e, f in zip(*bands, strict=True) if f.any()]
            continue
        empty = each[cut[1:] == cut[:-1]]
        three = np.array(list(itertools.combinations(empty, 3)), np.uint64).reshape(-1, 3)
        three = W.mixed(W.mixed(three[:, 0] + three[:, 1] * np.uint64(0xDA942042E4DD58B5)) + three[:, 2])
        out.append(np.append(each[cut[1:] > cut[:-1]], three))
    return out


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of the set."""
    sums = [W.mixed(tokens ^ np.uint64(x)).sum(dtype=np.uint64) for x in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]
    return tuple(int(np.int64(x.astype(np.int64))) for x in sums)  # type: ignore[return-value]


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    hashes, at = W.words(texts)
    for a, b in zip(at, at[1:], strict=False):
        yield W.shingles(hashes[a:b], k)


def _signed(rows: DataFrame, k: int, similarity: int) -> DataFrame:
    """rid, doc_id, n, ka, kb, sigs of rid, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, ka, kb, sigs = [], [], [], []
                for tokens in _sets(batch.column(2), k):
                    n.append(len(tokens))
                    a, b = set_key(tokens) if len(tokens) else (None, None)
                    ka.append(a)
                    kb.append(b)
                    sigs.append([s.astype(np.int64) for s in signatures(tokens, similarity)] if len(tokens) else None)
                long = pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, long), pa.array(ka, long), pa.array(kb, long), pa.array(sigs, pa.list_(pa.list_(long)))],
                    names=["rid", "doc_id", "n", "ka", "kb", "sigs"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"rid long, doc_id {kind}, n long, ka long, kb long, sigs array<array<long>>")


def _tokens_of(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """id, ka, kb, tokens of the texts whose doc_id one of ``nodes`` has, and perhaps of some others: sets made again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                found = [(i, *set_key(t), t.astype(np.int64)) for i, t in enumerate(_sets(part.column(1), k)) if len(t)]
                row, ka, kb, tokens = ([x[i] for x in found] for i in range(4))
                ids = part.column(0).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(ka, pa.int64()), pa.array(kb, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["id", "ka", "kb", "tokens"]
                )

    texts = sieved(docs.select("doc_id", "text"), F.col("doc_id"), nodes.select("doc_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, ka long, kb long, tokens array<long>")


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for all nodes of links (a, b), by large and small stars."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = keep(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = state(edges)
    while before[0]:
        around = both(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = keep(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m"))).alias("x"))
        small = keep(small.select("x.a", F.col("x.m").alias("b")).filter("a != b").distinct(), "links")
        drop(edges, large)
        edges, now = small, state(small)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted (sig, node) whose sig is that of the row before or after."""
    held: tuple[int, int, bool] | None = None  # the last row, and whether its sig was there before
    for batch in batches:
        sig, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        if held:
            sig, node = np.append(held[0], sig), np.append(held[1], node)
        same = sig[1:] == sig[:-1]
        fits = np.append(same, False) | np.append(bool(held and held[2]), same)
        held = (sig[-1], node[-1], bool(fits[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(sig[:-1][fits[:-1]]), pa.array(node[:-1][fits[:-1]])], names=["sig", "node"])
    if held and held[2]:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], names=["sig", "node"])


def _overlaps(tokens: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many tokens each of the sets ``left`` shares with each of ``right``; set i is tokens[at[i]:at[i + 1]]."""
    both = np.zeros((len(left), len(right)), np.int64)
    names, ids, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    ids = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[ids]
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], np.repeat(np.arange(len(at) - 1), np.diff(at))[order]
    lo = int(np.searchsorted(ids, 0))
    ids, row = ids[lo:], row[lo:]
    for c in range(0, int(ids[-1]) + 1 if len(ids) else 0, COLUMNS):
        a, b = np.searchsorted(ids, (c, c + COLUMNS))
        there = np.zeros((len(at) - 1, min(COLUMNS, int(ids[-1]) + 1 - c)), np.float32)
        there[row[a:b], ids[a:b] - c] = 1
        both += (there[left] @ there[right].T).astype(np.int64)
    return both


def _least_linked(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least column that each row and each column of a matrix of links is connected with; columns without links: themselves."""
    none = link.shape[1]
    column = np.arange(none)
    while True:
        row = np.where(link, column, none).min(axis=1, initial=none)
        new = np.minimum(column, np.where(link, row[:, None], none).min(axis=0, initial=none))
        new = new[new]
        if np.array_equal(new, column):
            return row, column
        column = new


class _Group:
    """The members of a group, or a part of its queries with them."""

    def __init__(self, similarity: int):
        self.similarity = similarity
        self.node: list[int] = []
        self.rows: list[int] = []
        self.sets: list[np.ndarray] = []
        self.union: np.ndarray | None = None
        self.asked: list[tuple[int, np.ndarray]] = []
        self.weight = 0

    def linked(self, left: list[np.ndarray]) -> np.ndarray:
        """Which of the sets ``left`` link with which members."""
        sets = [*left, *self.sets]
        size = np.array([len(x) for x in sets])
        ours = np.arange(len(left), len(sets))
        both = _overlaps(np.concatenate(sets), np.append(0, np.cumsum(size)), np.arange(len(left)), ours)
        return 100 * both >= self.similarity * (size[: len(left), None] + size[None, ours] - both)

    def within(self) -> Iterator[tuple[np.ndarray, ...]]:
        """a, b and a's links of members that link with others: b is the least one that a is connected with."""
        if len(self.node) < 2:
            return
        link = self.linked(self.sets)
        node, rows, (least, _) = np.array(self.node), np.array(self.rows), _least_linked(link)
        at = np.flatnonzero(link.sum(axis=1) > 1)  # all link with themselves
        yield node[at], node[least[at]], (link @ rows - rows)[at]

    def put(self, node: int, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        self.asked.append((node, tokens))
        self.weight += max(len(tokens), LIGHT)
        if self.weight > BLOCK:
            yield from self.answers()

    def answers(self) -> Iterator[tuple[np.ndarray, ...]]:
        """a, b and a's links of the queries that link with members, and edges between members that one query connects."""
        asked, self.asked, self.weight = self.asked, [], 0
        if not asked or not self.sets:
            return
        if self.union is None:
            self.union = np.unique(np.concatenate(self.sets))
        tokens, size = np.concatenate([t for _, t in asked]), np.array([len(t) for _, t in asked])
        there = self.union[np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)] == tokens
        bound = np.add.reduceat(there, np.append(0, np.cumsum(size)[:-1]))
        opened = [asked[i] for i in np.flatnonzero(100 * bound >= self.similarity * size)]
        if not opened:
            return
        link = self.linked([t for _, t in opened])
        at = np.flatnonzero(link.any(axis=1))
        node, (row, column) = np.array(self.node), _least_linked(link)
        yield np.array([q for q, _ in opened])[at], node[row[at]], (link @ np.array(self.rows))[at]
        at = np.flatnonzero(column != np.arange(len(column)))
        yield node[at], node[column[at]], np.zeros(len(at), np.int64)


def _opened(similarity: int):
    """g, part, query, node, rows, tokens, sorted by the first four → a, b, links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        last: tuple | None = None
        group = _Group(similarity)
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            plain = [batch.column(i).to_pylist() for i in range(5)]
            for i, (g, part, query, node, rows) in enumerate(zip(*plain, strict=True)):
                if (g, part, query, node) == last:  # rows of one text
                    continue
                if key != (g, part, query):
                    if key and not key[2] and key[1] == 0:
                        found += group.within()
                    if key and key[:2] != (g, part):
                        found += group.answers()
                        group = _Group(similarity)
                key, last = (g, part, query), (g, part, query, node)
                tokens = batch.column(5)[i].values.to_numpy().copy()
                if query:
                    found += group.put(node, tokens)
                else:
                    group.node.append(node)
                    group.rows.append(rows)
                    group.sets.append(tokens)
            yield _linked_rows(found)
        if key:
            yield _linked_rows([*(group.within() if not key[2] and key[1] == 0 else ()), *group.answers()])

    return run


def _linked_rows(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])


def _both_ways(there: DataFrame, least: int) -> DataFrame:
    """g, other of rows (sig, g) that have ``least`` values of sig in common."""
    met = there.join(there.withColumnRenamed("g", "other"), "sig").filter("g != other")
    return met.groupBy("g", "other").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("g", "other")


def _puts(there: DataFrame, of_group: DataFrame, least: int) -> DataFrame:
    """node, other: groups (sig, g) other than its own with which a node (node, sig, g) has ``least`` values of sig in common."""
    met = there.join(of_group.withColumnRenamed("g", "other"), "sig").filter("g != other")
    return met.groupBy("node", "other").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("node", "other")


def _counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct groups of lists of groups with times, and the sums of their times."""
    groups, times = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(groups, kind="stable")
    groups, times = groups[order], times[order]
    first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    return groups[first], np.add.reduceat(times, first)


def _often_met(least: int):
    """node, g, others, sorted by node → node, other: groups other than g that stand in ``least`` of a node's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def closed() -> tuple[np.ndarray, np.ndarray]:
            groups, times = _counts(parts)
            groups = groups[(times >= least) & (groups != last[1])]
            return np.full(len(groups), last[0], np.int64), groups

        def told(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            columns = [np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(2)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            node, own = (batch.column(i).to_numpy() for i in range(2))
            values = batch.column(2).flatten().to_numpy()
            ends = np.append(0, np.cumsum(batch.column(2).value_lengths().to_numpy()))
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            for a, b in zip(starts, np.append(starts[1:], len(node)), strict=True):
                if last and last[0] != node[a]:
                    found.append(closed())
                    parts, held = [], 0
                last = (node[a], own[a])
                met = values[ends[a] : ends[b]]
                parts.append((met, np.ones(len(met), np.int64)))
                held += len(met)
                if held > BLOCK:  # no more than the distinct groups stay
                    parts, held = [_counts(parts)], 0
            yield told(found)
        if last:
            yield told([closed()])

    return run


def _listed_puts(there: DataFrame, of_group: DataFrame, least: int) -> DataFrame:
    """As ``_puts`` for values of sig that ``COMMON`` groups have at most: a value's groups travel as one list, so the join has one row for each row of nodes."""
    lists = of_group.groupBy("sig").agg(F.collect_set("g").alias("others"))
    met = there.join(lists, "sig").select("node", "g", "others")
    return met.repartition("node").sortWithinPartitions("node").mapInArrow(_often_met(least), "node long, other long")


def _twice_shared(places: DataFrame) -> DataFrame:
    """Rows (sig, node) of nodes with two of them or more, whose sig another such node has."""
    nodes = places.groupBy("node").agg(F.count("*").alias("c")).filter("c > 1").select("node")
    places = places.join(nodes, "node", "left_semi")
    sigs = places.groupBy("sig").agg(F.count("*").alias("c")).filter("c > 1").select("sig")
    return places.join(sigs, "sig", "left_semi")


class Join:
    """The tables of one run: rows, classes of equal sets, links and components."""

    def __init__(self, docs: DataFrame, k: int, similarity: int):
        self.similarity = similarity
        rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
        self.signed = keep(_signed(rows, k, similarity), "sets")
        self.rows = keep(self.signed.drop("sigs"), "rows")
        classes = self.rows.filter("n > 0").groupBy("ka", "kb").agg(
            F.min(F.struct("rid", "doc_id")).alias("one"), F.min("doc_id").alias("first_id"), F.count("*").alias("rows"), F.min("n").alias("n")
        )
        self.classes = keep(classes.select("ka", "kb", F.col("one.rid").alias("node"), F.col("one.doc_id").alias("doc_id"), "first_id", "rows", "n"), "set-classes")
        # copies of one set send their signatures once
        each = sieved(self.signed.filter("n > 0").select("rid", "sigs"), F.col("rid"), self.classes.select("node"))
        each = each.select(F.explode(F.flatten("sigs")).alias("sig"), F.col("rid").alias("node"))
        parts = []
        for i in range(SLICES):
            shared = each.filter(F.pmod("sig", F.lit(SLICES)) == i).repartition("sig").sortWithinPartitions("sig").mapInArrow(_shared, "sig long, node long")
            parts.append(keep(shared.join(self.classes.select("node"), "node", "left_semi"), "signatures"))
        places = docs.sparkSession.read.schema(parts[0].schema).parquet(*(p.kept_at for p in parts))
        self.places = keep(_twice_shared(_twice_shared(places)), "places")
        drop(*parts)
        self.groups = self.grouped()
        self.met = self.meet(docs, k)
        self.comp = keep(components(self.met.select("a", "b")), "components")
        drop(self.places, self.groups)

    def grouped(self) -> DataFrame:
        """node, ka, kb, doc_id, rows, n, weight, g of the nodes that share a signature with another.

        A node's home is its signature that most nodes have. A home joins the largest
        one that shares a signature with it, and where that one goes; then it is cut.
        """
        often = self.places.groupBy("sig").agg(F.count("*").alias("c"))
        home = self.places.join(often, "sig").groupBy("node").agg(F.max(F.struct("c", "sig"))["sig"].alias("g"))
        home = keep(home.join(self.classes.drop("first_id"), "node").withColumn("weight", F.greatest("n", F.lit(LIGHT))), "homes")
        size = home.groupBy("g").agg(F.struct(F.count("*").alias("size"), "g").alias("own"))
        near = self.neighbours(home)
        beside = near.join(size.select(F.col("g").alias("other"), F.col("own").alias("theirs")), "other").groupBy("g").agg(F.max("theirs").alias("theirs"))
        up = keep(size.join(beside, "g", "left").select("g", F.greatest("own", "theirs")["g"].alias("up")), "larger-homes")
        top = up.join(up.select(F.col("g").alias("up"), F.col("up").alias("top")), "up").select("g", "top")
        home = home.join(top, "g").drop("g")
        size = home.groupBy("top").agg(F.sum("weight").alias("all"))
        slot = F.pmod(F.xxhash64("node"), F.ceil(F.col("all") / BLOCK).cast("long"))
        return keep(home.join(size, "top").withColumn("g", F.xxhash64("top", slot)).drop("top", "all"), "groups")

    def neighbours(self, groups: DataFrame) -> DataFrame:
        """g, other: groups (node, g) that share two signatures, both ways, but for signatures of more than ``COMMON`` groups."""
        there = keep(self.places.join(groups.select("node", "g"), "node").select("sig", "g").distinct(), "group-signatures")
        often = there.groupBy("sig").agg(F.count("*").alias("c")).filter(F.col("c").between(2, COMMON)).select("sig")
        near = keep(_both_ways(there.join(often, "sig", "left_semi"), 2), "neighbours")
        drop(there)
        return near

    def meeting(self) -> DataFrame:
        """node, other: the groups that a node is put to; it shares two signatures with each, or a pair of them where one is too common."""
        own = self.groups.select("node", "g")
        there = keep(self.places.join(own, "node").select("node", "sig", "g"), "node-signatures")
        of_group = keep(there.select("sig", "g").distinct(), "group-signatures")
        often = keep(of_group.groupBy("sig").agg(F.count("*").alias("c")).filter("c > 1"), "shared-signatures")
        few = often.filter(F.col("c") <= COMMON).select("sig")
        asks = keep(_listed_puts(there.join(few, "sig", "left_semi"), of_group.join(few, "sig", "left_semi"), 2), "asks")
        common = often.filter(F.col("c") > COMMON).select("sig")
        if not common.isEmpty():
            pairs = keep(self.refined(common).join(own, "node"), "signature-pairs")
            asks = keep(asks.union(_puts(pairs, pairs.select("sig", "g").distinct(), 1)).distinct(), "asks")
            drop(pairs)
        drop(there, of_group, self.signed)
        return asks

    def refined(self, common: DataFrame) -> DataFrame:
        """sig, node: common signatures in combination with each other shared one of the node's band."""
        held = self.places.join(common, "sig", "left_semi").select("node").distinct()
        bands = self.signed.select(F.col("rid").alias("node"), "sigs").join(held, "node", "left_semi").select("node", F.posexplode("sigs").alias("band", "own"))
        bands = bands.select("node", "band", F.explode("own").alias("sig")).join(self.places, ["node", "sig"], "left_semi")
        bands = keep(bands.join(common.withColumn("common", F.lit(True)), "sig", "left"), "bands")
        with_one = bands.filter("common").select("node", "band", "sig").join(bands.select("node", "band", F.col("sig").alias("other")), ["node", "band"]).filter("sig != other")
        return with_one.select(F.xxhash64(F.least("sig", "other"), F.greatest("sig", "other")).alias("sig"), "node").distinct()

    def meet(self, docs: DataFrame, k: int) -> DataFrame:
        """a, b, links: what the tasks of the matrix find. a's links are the sum over its rows, b is a node that a is connected with."""
        node = self.groups.select("node", F.col("doc_id").alias("id"), "ka", "kb", "rows", "n", "g", "weight")
        stats = node.groupBy("g").agg(F.count("*").alias("members"), F.sum("weight").alias("all"), F.min("n").alias("least"), F.max("n").alias("most"))
        stats = keep(stats, "group-sizes")
        asks = self.meeting().join(node.drop("g"), "node").join(stats.select(F.col("g").alias("other"), "least", "most"), "other")
        asks = asks.filter((100 * F.col("n") >= self.similarity * F.col("least")) & (100 * F.col("most") >= self.similarity * F.col("n")))
        asks = keep(asks.select("other", "node", "id", "ka", "kb", "rows", "weight"), "asks")
        load = asks.groupBy(F.col("other").alias("g")).agg(F.sum("weight").alias("asked"))
        parts = F.ceil(F.coalesce("asked", F.lit(1)) / (QUERIES * BLOCK)).cast("long").alias("parts")
        plan = keep(stats.join(load, "g", "left").filter("members > 1 or asked is not null").select("g", parts), "group-parts")
        members = node.join(plan, "g").select("id", "ka", "kb", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("query"), "node", "rows")
        asks = asks.withColumnRenamed("other", "g").join(plan, "g")
        asks = asks.select("id", "ka", "kb", "g", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), F.lit(True).alias("query"), "node", "rows")
        rows = keep(members.union(asks), "matrix")
        active = keep(rows.select(F.col("id").alias("doc_id")).distinct(), "active")
        # of rows with one set, those of the node's own doc_id
        found = _tokens_of(docs, active, k).withColumnRenamed("id", "of").join(rows, ["ka", "kb"]).filter(F.col("of").eqNullSafe(F.col("id")))
        found = found.select("g", "part", "query", "node", "rows", "tokens").repartition("g", "part").sortWithinPartitions("g", "part", "query", "node")
        out = keep(found.mapInArrow(_opened(self.similarity), "a long, b long, links long"), "met")
        drop(stats, plan, rows)
        return out

    def with_comp(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def counted(self) -> DataFrame:
        """node, links of all nodes: the other rows of ``docs`` that each of the node's rows links with."""
        found = self.met.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
        return self.classes.join(found, "node", "left").select("node", (F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("links"))


def jaccard_components(docs: DataFrame, k: int = 5, similarity: int = 80, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and, if wanted, n_links: one row per row of ``docs``.

    ``similarity`` is in hundredths: two rows link when 100 * intersection >=
    similarity * union of their shingle sets. ``component_id`` is the smallest doc_id
    that links reach, ``n_links`` the number of other rows that the row links with. A text of fewer than ``k`` words is one shingle; a null text, an
    empty one or one of white space has none and links with nothing. Repeated rows and
    repeated doc_ids are rows of their own, compared like all others; null doc_ids are
    larger than none (a component of only null ids has a null id). Other columns are
    ignored; an empty table gives an empty result.
    """
    out = _classed(docs, k, similarity, links)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component, *[F.coalesce("links", F.lit(0).cast("long")).alias("n_links")] * links)


def _classed(docs: DataFrame, k: int, similarity: int, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, ka, kb, component_id, chosen: ``chosen`` marks the rows of one set of each component, with its component_id.

    With ``links`` their number as well, null without words.
    """
    if not 50 < similarity <= 100:
        raise ValueError("similarity: 51 to 100 hundredths")
    join = Join(docs, k, similarity)
    named = keep(join.with_comp(join.classes), "named")
    # nulls are larger than all ids
    first = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node")
    least = keep(named.groupBy("comp").agg(F.min(first).alias("first")), "component-ids")
    named = named.join(least, "comp").select("ka", "kb", F.col("first.first_id").alias("component_id"), (F.col("node") == F.col("first.node")).alias("chosen"), "node")
    named = (named.join(join.counted(), "node") if links else named).drop("node")
    rows = join.rows.select("doc_id", F.col("n").alias("n_shingles"), "ka", "kb").join(keep(named, "class-ids"), ["ka", "kb"], "left")
    return rows.withColumn("chosen", F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, with the smallest doc_id, and all rows without words.

    Where a doc_id is repeated, its rows are told apart by their sets; of rows that
    repeat both, one stays. Columns of any name pass.
    """
    doc, ka, kb = free(docs, "doc", "ka", "kb")
    found = keep(_classed(docs, k, similarity), "classed")
    stays = F.coalesce("chosen", F.lit(False)) | (F.col("n_shingles") == 0)
    by_id = found.groupBy(F.struct("doc_id").alias(doc)).agg(F.count("*").alias("c"), F.bool_or(stays).alias("some"))
    by_id = keep(by_id.filter("c > 1 or not some"), "gone-or-repeated")
    rows = docs.withColumn(doc, F.struct("doc_id"))
    once = rows.join(by_id, doc, "left_anti")
    repeated = rows.join(by_id.filter("c > 1 and some").select(doc), doc, "left_semi")
    keys = found.filter("chosen").select(F.struct("doc_id").alias(doc), F.col("ka").alias(ka), F.col("kb").alias(kb)).distinct()
    keyed = _with_key(repeated, k, ka, kb)
    kept = keyed.filter(F.col(ka).isNotNull()).join(keys, [doc, ka, kb], "left_semi").dropDuplicates([doc, ka, kb])
    return once.unionByName(kept.unionByName(keyed.filter(F.col(ka).isNull())).drop(ka, kb)).drop(doc)


def _with_key(rows: DataFrame, k: int, ka: str, kb: str) -> DataFrame:
    """``rows`` with the keys of their sets, null without words."""
    at = rows.columns.index("text")
    out = T.StructType([*rows.schema.fields, T.StructField(ka, T.LongType()), T.StructField(kb, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_key(t) if len(t) else (None, None) for t in _sets(batch.column(at), k)]
            new = [pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, ka, kb])

    return rows.mapInArrow(run, out)
