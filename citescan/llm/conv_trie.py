"""The prefix trie of conversations: how much of them is shared, turn by turn.

A node is a distinct sequence of first turns; its key is a chain of SHA-256 digests
over the turns. Each partition reads its conversations as a stream of sorted turns and
emits a table of the nodes that it met, locally combined: a node met by thousands of
its conversations is one row. A table that grows beyond ``NODES`` nodes or ``ENDS``
listed ends is emitted and begun anew, so a task's memory is bounded; partial tables
may overlap, since merging them only sums and takes minima. Merging is keyed by hash,
first within shards of the partial tables, then over the shards, so even the root,
which all conversations have, is a few rows before it meets in one place.

Values of subtrees flow from the leaves to the root by pointers that double, so a chain of n
turns takes log2(n) rounds: after round k a node has the sum of all nodes less than
2^k below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citescan.session import drop, keep

#: nodes and listed ends of a partial table
NODES, ENDS = 50_000, 50_000
#: partial tables that are merged at first
SHARDS = 16
ROOT = hashlib.sha256(b"").digest()


def said(role: Column, text: Column) -> Column:
    """A digest of a turn: of the role's length, the role and the text; nulls are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


_PARTIAL = pa.schema(
    [("key", pa.binary()), ("up", pa.binary()), ("depth", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("chars", pa.int64()), ("ends", pa.list_(pa.int64()))]
)
PARTIAL = "key binary, up binary, depth long, first long, n long, chars long, ends array<long>"


class _Table:
    """A partial trie: first member, members, parent, depth and characters of each node, and the members that end there."""

    def __init__(self) -> None:
        self.nodes: dict[bytes, list] = {}
        self.listed = 0

    def met(self, key: bytes, up: bytes | None, depth: int, chars: int, conv: int) -> None:
        node = self.nodes.get(key)
        if node is None:
            self.nodes[key] = [up, depth, conv, 1, chars, []]
        else:
            node[2] = min(node[2], conv)
            node[3] += 1

    def ends(self, key: bytes, conv: int) -> None:
        # the node may have gone with an emitted table: then only the end is told here
        self.nodes.setdefault(key, [None, None, None, 0, None, []])[5].append(conv)
        self.listed += 1

    def rows(self) -> pa.RecordBatch:
        columns = list(zip(*[(k, up, depth, first, n, chars, ends) for k, (up, depth, first, n, chars, ends) in self.nodes.items()], strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTIAL, strict=True)], schema=_PARTIAL)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, pos, said, chars, sorted by the first two, pos 0 the root → partial tables."""
    table, conv, key = _Table(), None, ROOT
    for batch in batches:
        for c, pos, digest, chars in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if pos == 0:
                if conv is not None:
                    table.ends(key, conv)
                if len(table.nodes) > NODES or table.listed > ENDS:
                    yield table.rows()
                    table = _Table()
                conv, key = c, ROOT
                table.met(ROOT, None, 0, 0, conv)
                continue
            up, key = key, hashlib.sha256(key + digest).digest()
            if len(table.nodes) > 2 * NODES:  # one conversation of very many turns
                yield table.rows()
                table = _Table()
            table.met(key, up, pos, chars, conv)
    if conv is not None:
        table.ends(key, conv)
    yield table.rows()


def merged(partial: DataFrame) -> DataFrame:
    """Nodes of partial tables: key, up, depth, chars, first, n; merged within shards of their partitions, then over the shards."""
    values = [F.max("up").alias("up"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.min("first").alias("first"), F.sum("n").alias("n")]
    once = partial.drop("ends").withColumn("shard", F.pmod(F.spark_partition_id(), F.lit(SHARDS))).groupBy("key", "shard").agg(*values)
    return once.drop("shard").groupBy("key").agg(*values)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, conv sorted → key, ends_sha256: the list of each key is digested as it streams by."""
    key, digest, found = None, None, []
    for batch in batches:
        for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    found.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(str(conv).encode())
            else:
                digest.update(b",%d" % conv)
        yield _named(found)
        found = []
    if key is not None:
        yield _named([(key, digest.hexdigest())])


def _named(found: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([d for _, d in found], pa.string())], names=["key", "ends_sha256"])


def rolled_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """key and, for each of ``values``, its sum over the node's subtree, the node included; nodes has key, up and the values."""
    state = keep(nodes.select("key", "up", *values), "trie-sums")
    ended: list[DataFrame] = []
    while not (live := state.filter("up is not null")).isEmpty():
        # sums of the nodes 2^k below go up, pointers double
        given = live.groupBy(F.col("up").alias("key")).agg(*[F.sum(v).alias(f"{v}_below") for v in values])
        above = state.select(F.col("key").alias("up"), F.col("up").alias("up2"))
        more = state.join(given, "key", "left").join(above, "up", "left")
        sums = [(F.col(v) + F.coalesce(f"{v}_below", F.lit(0))).alias(v) for v in values]
        new = keep(more.select("key", F.col("up2").alias("up"), *sums), "trie-sums")
        ended.append(state)
        state = new
    drop(*ended)
    return state.drop("up")


def digested(turns: DataFrame) -> DataFrame:
    """conv_id, pos, said, chars of conv_id, pos, role, text: what ``trie`` needs of a turn, in some 50 bytes."""
    return turns.select("conv_id", F.col("pos").cast("long").alias("pos"), said(F.col("role"), F.col("text")).alias("said"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))


def trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node.

    ``turns`` (see ``digested``) has a row with pos 0 for each conversation, so that one
    without turns is a member of the root, and one for each pos 1, 2, ... without gaps
    or repeats. Rows with a null conv_id belong to no conversation and are left out; an
    empty table gives an empty result.

    ``conv_id`` is the smallest member, which with the depth names the node.
    ``saved_tokens`` are code points of last texts that a shared prefix saves, summed
    over the subtree. ``ends_sha256`` digests the ids, ascending, of the conversations
    that end at the node.
    """
    rows = turns.filter("conv_id is not null").select("conv_id", "pos", "said", "chars")
    partial = keep(rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_partial, PARTIAL), "partial-tries")
    nodes = keep(merged(partial), "trie-nodes")
    ends = partial.select("key", F.explode("ends").alias("conv")).repartition("key").sortWithinPartitions("key", "conv")
    ends = ends.mapInArrow(_digests, "key binary, ends_sha256 string")
    children = nodes.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = keep(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-children")
    own = nodes.select("key", "up", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved_tokens"))
    parents = nodes.select(F.col("key").alias("up"), F.col("first").alias("parent_conv_id"))
    out = nodes.join(rolled_up(own, ["n_leaves", "saved_tokens"]), "key").join(parents, "up", "left").join(ends, "key", "left")
    return out.select(
        F.col("first").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text of conv_id, turn, role, text: by turn, null first, ties by role and text.

    Null roles and texts become empty; rows without conv_id go; other columns are ignored.
    """
    rows = rows.filter("conv_id is not null").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "role", "text")


def with_shared_heads(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Turns for ``trie`` in which each conversation begins with turns of the one whose id is the last multiple of ``every``.

    ``turns`` has conv_id, pos, said and chars. Of conversation c the first h turns,
    h = crc32(c) % ``most``, are replaced by the first h of c - c % every (all if it
    has fewer, none if it is absent). A row of pos 0 opens each conversation.
    """
    c = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % most
    heads = turns.filter((c % every == 0) & (F.col("pos") < most))
    had = heads.groupBy(F.col("conv_id").alias("head")).agg(F.count("*").alias("had"))
    convs = turns.select("conv_id").distinct().select("conv_id", (c - c % every).alias("head"), h.alias("h"))
    convs = keep(convs.join(had, "head", "left").select("conv_id", "head", F.least("h", F.coalesce("had", F.lit(0))).alias("shared"), "h"), "shared-heads")
    opened = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.unhex(F.lit("")).alias("said"), F.lit(0).cast("long").alias("chars"))
    shared = convs.join(heads.withColumnRenamed("conv_id", "head"), "head").filter(F.col("pos") <= F.col("shared")).select("conv_id", "pos", "said", "chars")
    # where the head has fewer than h turns the conversation's own move up
    own = turns.filter(F.col("pos") > h).join(convs.drop("head"), "conv_id")
    return opened.union(shared).union(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "said", "chars"))
