"""Approximate nearest neighbours by inner product, on a graph built by NN-descent.

Equal vectors are one node. For the graph each vector gets one more component that
gives all the same length, so that inner products order nodes as distances do. The
first graph joins nodes that fall into the same leaf of a few random trees; then
NN-descent improves it: around each node its neighbours and those that have it as
neighbour meet, and pairs closer than what they know enter their lists. A round is
a join of lists with vectors and a shuffle by the middle node. Rounds end when
fewer than ``SETTLED`` of all list entries change.

A query starts at its own node and walks greedily: in each round the nearest nodes
of its beam that were not opened yet show their neighbours, until all are or for
``STEPS`` rounds. The best are then scored in double precision on the original vectors.

The trees' upper levels are fitted on a sample of at most ``SAMPLE`` nodes; below
them tasks split their own cell further. Every node is in the graph.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citescan.session import drop, keep

SAMPLE = 8192
#: nodes of a cell of a tree, on average; a leaf within a cell has at most LEAF
CELL, LEAF = 4096, 192
TREES = 8
#: neighbours in a node's list; of them, and of those that list it, so many meet in a round
LIST, MEET = 32, 24
#: pairs of a round that one meeting tells a node of, at most
TOLD = 8
DESCENTS, SETTLED = 6, 0.02
#: links of a node in the graph that queries walk, either way
LINKS = 48
#: nodes that a query keeps and opens in a round
BEAM, OPEN, STEPS = 256, 32, 12

NEAR = "array<struct<sim:double,w:long>>"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, x (array<double>) of rows whose vector takes part.

    Left out: null vec_id, null vectors, zero vectors, vectors with a null or
    non-finite component, and vectors whose length is not that of most rows.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.select("vec_id", x.alias("x")).filter("vec_id is not null and x is not null").filter(fine)
    length = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).first()
    return rows.filter(F.size("x") == (length["d"] if length else 0))


def _split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """A direction between two random points and the median along it."""
    a, b = rng.choice(len(x), 2, replace=False)
    direction = x[a] - x[b]
    if not direction.any():
        direction = rng.standard_normal(x.shape[1])
    return direction, float(np.median(x @ direction))


def _grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> list[list[tuple[np.ndarray, float]]]:
    """Splits by level; level i has 2^i of them."""
    cells, levels = [x], []
    for _ in range(depth):
        splits, below = [], []
        for cell in cells:
            s = _split(cell, rng) if len(cell) > 1 else (rng.standard_normal(x.shape[1]), 0.0)
            right = cell @ s[0] > s[1]
            splits.append(s)
            below += [cell[~right], cell[right]]
        levels.append(splits)
        cells = below
    return levels


def _cell_of(x: np.ndarray, levels: list[list[tuple[np.ndarray, float]]]) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for splits in levels:
        d, m = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
        at = 2 * at + (np.einsum("ij,ij->i", x, d[at]) > m[at])
    return at


def _leaves(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        direction, _ = _split(x[at], rng)
        order = at[np.argsort(x[at] @ direction, kind="stable")]
        todo += [order[: len(at) // 2], order[len(at) // 2 :]]
    return out


def _vectors(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _nearest(x: np.ndarray, ids: np.ndarray, count: int) -> list[list[dict]]:
    """Each row's nearest others in the block; similarities are summed anew so that a pair has one value everywhere."""
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    count = min(count, len(ids) - 1)
    if count <= 0:
        return [[] for _ in ids]
    top = np.argpartition(-sims, count - 1, axis=1)[:, :count]
    exact = (x[:, None, :] * x[top]).sum(-1)
    return [[{"sim": float(s), "w": int(w)} for s, w in zip(row, ids[at], strict=True)] for row, at in zip(exact, top, strict=True)]


_NEAR = pa.list_(pa.struct([("sim", pa.float64()), ("w", pa.int64())]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, which the partition is sorted by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and b > a and held[-1].column(0)[0].as_py() != key[a]:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def merged(lists: DataFrame) -> DataFrame:
    """node, near: each node's LIST nearest of all its lists."""
    near = F.sort_array(F.array_distinct(F.flatten(F.collect_list("near"))), asc=False)
    return lists.groupBy("node").agg(F.slice(near, 1, LIST).alias("near"))


def first_graph(nodes: DataFrame, seed: int) -> DataFrame:
    """Lists of the leaf mates in TREES trees."""
    n = nodes.count()
    depth = max(0, math.ceil(math.log2(max(1, n / CELL))))
    sample = _vectors(_whole(nodes.orderBy(F.xxhash64(F.lit(seed), "node")).limit(SAMPLE).select("x").toArrow().column("x")))
    trees = nodes.sparkSession.sparkContext.broadcast([_grow(sample, depth, np.random.default_rng([seed, t])) for t in range(TREES)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(1), np.float32)
            for t, levels in enumerate(trees.value):
                cell = _cell_of(x, levels) + (t << depth)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1)], names=["cell", "node", "x"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches):
            x, ids = _vectors(_whole(cell.column("x")), np.float32), cell.column("node").to_numpy()
            order = np.argsort(ids)
            x, ids = x[order], ids[order]
            for at in _leaves(x, np.random.default_rng([seed, int(cell.column("cell")[0].as_py())])):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(_nearest(x[at], ids[at], LIST), _NEAR)], names=["node", "near"])

    placed = nodes.select("node", "x").mapInArrow(place, "cell long, node long, x array<float>")
    return merged(placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, f"node long, near {NEAR}"))


def descend(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """One round of NN-descent."""
    links = graph.select("node", F.posexplode("near").alias("pos", "e")).select("node", "pos", F.col("e.w").alias("w"), F.col("e.sim").alias("sim"))
    ahead = links.filter(F.col("pos") < MEET).select(F.col("node").alias("middle"), F.col("w").alias("node"))
    best = Window.partitionBy("w").orderBy(F.desc("sim"), "node")
    behind = links.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= MEET).select(F.col("w").alias("middle"), "node")
    worst = graph.select("node", F.when(F.size("near") >= LIST, F.element_at("near", -1)["sim"]).otherwise(F.lit(float("-inf"))).alias("worst"))
    known = nodes.select("node", "x").join(worst, "node")
    met = ahead.union(behind).distinct().join(known, "node").select("middle", "node", "worst", "x")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches):
            ids, worst = group.column("node").to_numpy(), group.column("worst").to_numpy()
            x = _vectors(_whole(group.column("x")), np.float32)
            sims = x @ x.T
            np.fill_diagonal(sims, -np.inf)
            if len(ids) > TOLD + 1:
                least = -np.partition(-sims, TOLD - 1, axis=1)[:, TOLD - 1]
                worst = np.maximum(worst, np.nextafter(least, -np.inf))
            a, b = np.nonzero(sims > worst[:, None])
            if not len(a):
                continue
            exact = (x[a] * x[b]).sum(-1)
            first = np.flatnonzero(np.diff(a, prepend=-1))
            ends = [*first[1:].tolist(), len(a)]
            lists = [[{"sim": float(exact[k]), "w": int(ids[b[k]])} for k in range(s, e)] for s, e in zip(first, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[first]]), pa.array(lists, _NEAR)], names=["node", "near"])

    news = met.repartition("middle").sortWithinPartitions("middle").mapInArrow(meet, f"node long, near {NEAR}")
    return merged(graph.select("node", "near").union(news))


def build(nodes: DataFrame, seed: int = 5) -> DataFrame:
    """node, near of nodes (node, x)."""
    graph = keep(first_graph(nodes, seed), "graph")
    for _ in range(DESCENTS):
        new = keep(descend(graph, nodes), "graph")
        old = graph.select("node", F.col("near").alias("old"))
        both = new.join(old, "node").agg(F.sum(F.size("near")).alias("all"), F.sum(F.size(F.array_except("near", "old"))).alias("new")).first()
        drop(graph)
        graph = new
        if not both["all"] or both["new"] < SETTLED * both["all"]:
            break
    return graph


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def walkable(graph: DataFrame) -> DataFrame:
    """node, next: the LINKS nearest of the nodes that it lists or that list it."""
    links = graph.select("node", F.explode("near").alias("e")).select("node", F.col("e.w").alias("w"), F.col("e.sim").alias("sim"))
    links = links.union(links.select(F.col("w").alias("node"), F.col("node").alias("w"), "sim")).distinct()
    best = Window.partitionBy("node").orderBy(F.desc("sim"), "w")
    links = links.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= LINKS)
    return links.groupBy("node").agg(F.collect_list("w").alias("next"))


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, w, x, y → node, w, score."""
    for batch in batches:
        score = np.zeros(0)
        if batch.num_rows:
            score = np.einsum("ij,ij->i", _vectors(batch.column(2), np.float32), _vectors(batch.column(3), np.float32)).astype(np.float64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["node", "w", "score"])


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, beam (array of score, w, opened) of queries (node, x), which are nodes of the graph; scores in single precision."""
    near = keep(walkable(graph), "walk").select(F.col("node").alias("at"), "next")
    single = F.transform("x", lambda v: v.cast("float"))
    vectors = keep(nodes.select(F.col("node").alias("w"), single.alias("y")), "single")
    queries = queries.select("node", single.alias("x"))
    entry = F.struct(dot(F.col("x"), F.col("x")).cast("double").alias("score"), F.col("node").alias("w"), F.lit(False).alias("opened"))
    beam = keep(queries.select("node", "x", F.array(entry).alias("beam"), F.array("node").alias("seen")), "beam")
    none = F.expr("cast(array() as array<struct<score:double,w:long,opened:boolean>>)")
    for _ in range(STEPS):
        fresh = F.transform(F.slice(F.filter("beam", lambda e: ~e["opened"]), 1, OPEN), lambda e: e["w"])
        step = beam.select("node", F.explode(fresh).alias("at"))
        shown = step.join(near, "at").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
        shown = shown.join(beam.select("node", "x", "seen"), "node").select("node", "x", F.explode(F.array_except("next", "seen")).alias("w"))
        scored = shown.join(vectors, "w").select("node", "w", "x", "y").mapInArrow(_scored, "node long, w long, score double")
        came = scored.groupBy("node").agg(F.collect_list(F.struct("score", "w", F.lit(False).alias("opened"))).alias("came"))
        opened = F.transform("beam", lambda e: F.struct(e["score"].alias("score"), e["w"].alias("w"), (e["opened"] | F.array_contains(fresh, e["w"])).alias("opened")))
        whole = F.slice(F.sort_array(F.concat(opened, F.coalesce("came", none)), asc=False), 1, BEAM)
        seen = F.concat("seen", F.transform(F.coalesce("came", none), lambda e: e["w"]))
        before, beam = beam, keep(beam.join(came, "node", "left").select("node", "x", whole.alias("beam"), seen.alias("seen")), "beam")
        drop(before)
        if beam.filter(F.exists("beam", lambda e: ~e["opened"])).isEmpty():
            break
    return beam.select("node", "beam")


def nearest(rows: DataFrame, is_query: Column, k: int = 20, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of rows (vec_id, embedding) that is a query.

    Nearness is the inner product in double precision, ties go to the smaller vec_id;
    all candidates, if there are fewer than k. Rows that ``usable`` leaves out take no
    part. Rows that repeat vec_id and vector count once, and a query is no candidate
    of itself. Other columns are ignored. An empty table gives an empty result.
    """
    x = keep(usable(rows), "vectors")
    kinds = keep(x.groupBy("x").agg(F.min("vec_id").alias("node")), "nodes")
    if kinds.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    members = keep(x.join(kinds, "x").select("vec_id", "node").distinct(), "members")
    order = Window.partitionBy("node").orderBy("vec_id")
    copies = members.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    far = kinds.agg(F.max(dot(F.col("x"), F.col("x")))).first()[0]
    lift = F.sqrt(F.greatest(F.lit(0.0), F.lit(far) - dot(F.col("x"), F.col("x"))))
    level = keep(kinds.select("node", F.transform(F.concat("x", F.array(lift)), lambda v: v.cast("float")).alias("x")), "lifted")
    graph = build(level, seed)
    asked = members.filter(is_query).select("vec_id", "node")
    asked = keep(asked, "queries")
    beam = search(kinds.join(asked.select("node").distinct(), "node").select("node", "x"), graph, kinds)
    # the best of each beam, and some more against the rounding, scored again
    found = beam.select(F.col("node").alias("q"), F.explode(F.slice("beam", 1, 2 * k + 8)).alias("e")).select("q", F.col("e.w").alias("node"))
    one, two = kinds.select(F.col("node").alias("q"), "x"), kinds.select("node", F.col("x").alias("y"))
    found = found.join(one, "q").join(two, "node").select("q", "node", dot(F.col("x"), F.col("y")).alias("score"))
    each = found.join(copies, "node").groupBy("q").agg(F.collect_list(F.struct(F.col("score"), F.col("ids"))).alias("kinds"))
    flat = F.flatten(F.transform("kinds", lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("s"), i.alias("vec_id")))))
    lists = each.select(F.col("q").alias("node"), F.slice(F.sort_array(flat), 1, k + 1).alias("all"))
    out = asked.join(lists, "node").withColumn("mine", F.col("vec_id"))
    out = out.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter("all", lambda c: c["vec_id"] != F.col("mine")), 1, k)).alias("pos", "c"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), (-F.col("c.s")).alias("score"))
