"""Chat formatting over reply trees.

Messages reply to messages. Each message learns its ancestor at distance 1, 2, 4,
... by self-joins of the reply links, which also sums scores along the way, so a
chain of n replies takes log2(n) joins. Root-to-leaf paths are ranked by their
score within a conversation, and the chosen ones are unrolled by the same links
in reverse, from the longest to the shortest, so that only nodes of chosen paths
are ever listed. Each chosen path becomes one text.

The text marks turns with control strings. Control strings inside roles and texts
are broken up by a backslash after their first character, and backslashes are
doubled, so a reader gets back exactly what was written.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citescan.session import keep

START, END = "<|im_start|>", "<|im_end|>\n"
#: strings that common chat templates give a meaning
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def escaped(text: Column, newlines: bool = False) -> Column:
    """``text`` with a backslash before each backslash (and each newline) and inside each control string."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\\n])" if newlines else r"(\\)", r"\\$1")
    inner = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in CONTROL)
    return F.regexp_replace(text, inner, r"\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def reply_links(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The ancestors at distances 1, 2, 4, ... as tables of tree, node, up; and tree, node, total, steps from the root.

    A message leaves the doubling as soon as its root is reached, so a level costs
    what is left of the chains that are longer than its distance.
    """
    ids = messages.select("tree", F.col("node").alias("up"))
    link = messages.select("tree", "node", F.col("parent").alias("up"), "score").join(
        ids.withColumn("known", F.lit(True)), ["tree", "up"], "left"
    )
    link = link.select("tree", "node", F.when(F.col("known"), F.col("up")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps"))
    links = [keep(link, "replies")]
    ended, live = links[0].filter("up is null"), links[0].filter("up is not null")
    most = links[0].count()
    while 1 << len(links) <= 2 * most and not live.isEmpty():
        above = ended.union(live).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("steps").alias("steps2"))
        more = live.join(above, ["tree", "up"])
        more = more.select(
            "tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("steps") + F.col("steps2")).alias("steps")
        )
        links.append(keep(more, "replies"))
        ended, live = ended.union(links[-1].filter("up is null")), links[-1].filter("up is not null")
    return links, ended


def branches(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """tree, branch, pos, node of the ``top`` paths of each tree, by score, ties to the smaller leaf; None: all paths."""
    links, whole = reply_links(messages)
    parents = links[0].filter("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = whole.join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.col("total").desc_nulls_last(), "node")
    path = leaves.withColumn("branch", F.row_number().over(best))
    if top is not None:
        path = path.filter(F.col("branch") <= top)
    path = path.select("tree", "branch", "node", (F.col("steps") - 1).alias("pos"), F.col("steps").alias("len"))
    for level in reversed(range(len(links))):
        half = 1 << level
        jump = links[level].filter("up is not null").select("tree", "node", "up")
        path = path.join(jump, ["tree", "node"], "left")
        two = F.array(
            F.struct("node", "pos", F.lit(half).cast("long").alias("len")),
            F.struct(F.col("up").alias("node"), (F.col("pos") - half).alias("pos"), (F.col("len") - half).alias("len")),
        )
        parts = F.when(F.col("len") > half, two).otherwise(F.array(F.struct("node", "pos", "len")))
        path = path.select("tree", "branch", F.explode(parts).alias("x")).select("tree", "branch", "x.*")
    return path.select("tree", "branch", "pos", "node")


def conversations(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """conv_id, branch, formatted, loss: the chosen paths of each conversation as texts.

    ``messages`` has conv_id, msg_id, parent_id, role, text and score; other columns
    are ignored. ``loss`` lists start and end, in code points of ``formatted``, of
    each assistant's text as it stands there. A null conv_id is a conversation of
    its own; a message whose parent is null or missing starts a tree, and several
    trees of a conversation compete; null text and null role are empty, a null score
    is 0. Of messages that share conv_id and msg_id the first by parent, role and
    text stands. Messages on a cycle of replies, or without msg_id, are on no path.
    An empty table gives an empty result.
    """
    rows = messages.select(
        F.struct("conv_id").alias("tree"), F.col("msg_id").alias("node"),
        F.struct(F.col("parent_id").alias("parent"), "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).alias("m"),
    )
    rows = keep(rows.filter("node is not null").groupBy("tree", "node").agg(F.min("m").alias("m")).select("tree", "node", "m.*"), "messages")
    chosen = branches(rows.select("tree", "node", "parent", "score"), top)
    turn = F.struct("pos", escaped(F.col("role"), newlines=True).alias("role"), escaped(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("own"))
    paths = chosen.join(rows, ["tree", "node"]).groupBy("tree", "branch").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(END))), "")

    def mark(acc: Column, t: Column) -> Column:
        first = acc["at"] + F.length(head(t))
        last = first + F.length(t["text"])
        spans = F.when(t["own"], F.concat(acc["spans"], F.array(F.struct(first.alias("start"), last.alias("end"))))).otherwise(acc["spans"])
        return F.struct((last + len(END)).alias("at"), spans.alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    return paths.select("tree.conv_id", "branch", text.alias("formatted"), F.aggregate("turns", none, mark)["spans"].alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role, text."""
    parts = F.split(formatted, _quoted(END[:-1]) + r"\n", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = rf"^{_quoted(START)}((?:[^\\\n]++|\\[\s\S])*+)\n"
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, name, 1)).alias("role"),
            unescaped(F.substring(p, F.length(F.regexp_extract(p, name, 0)) + 1, F.length(p))).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, without anything between its parts."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def threads(rows: DataFrame) -> DataFrame:
    """Messages of a table of conv_id, turn, role, text: each row replies to the one before it, by turn, role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    return rows.select("conv_id", at.alias("msg_id"), F.lit(0.0).alias("score"), "role", "text").withColumn(
        "parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    )
