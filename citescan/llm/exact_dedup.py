"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by their length and then by successive runs of bytes of the
normalised text. A group leaves the recursion as soon as it holds one document
or its bytes have ended, so equality is decided by the bytes themselves and no
digest takes part. Runs grow from level to level: most documents part after the
first few bytes, and only true copies are read to their ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescan.llm.names import free
from citescan.session import keep

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def normalised(text):
    """A-Z lower-cased, other letters as they are; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def copy_groups(docs: DataFrame, first: int = 64, growth: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Level 0 compares the length in bytes and the first ``first`` characters, each
    later level ``growth`` times as many bytes as the one before. Only rows whose
    group has other members carry text to the next level.

    Null text equals empty text. Rows that repeat a doc_id count as rows of their
    own; of one doc_id's equal rows exactly one is kept. A null doc_id ranks below
    all others. Other columns of ``docs`` are ignored. An empty table gives an
    empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    head = F.translate(F.substring(text, 1, first), UPPER, LOWER)
    level = docs.select("doc_id", F.octet_length(text).cast("long").alias("gid"), head.alias("head"))
    shared = level.groupBy("gid", "head").agg(F.count("*").alias("n")).filter("n > 1")
    rows = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("rid"),
        F.octet_length(text).cast("long").alias("gid"),
        head.alias("head"),
        normalised(F.col("text")).cast("binary").alias("body"),
    ).withColumn("sha", F.sha2("body", 256))
    rows = rows.withColumn("left", F.col("gid") - F.octet_length("head")).withColumn(
        "rest", F.expr("substring(body, octet_length(head) + 1)")
    )
    level = keep(
        rows.join(shared, ["gid", "head"], "left").select(
            "doc_id", "rid", "gid", "head", "left", "sha", "n", F.when(F.col("n") > 1, F.col("rest")).alias("rest")
        ),
        "radix",
    )
    done = [level.filter("n is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")]
    live, width = level.filter("n is not null").drop("n"), first
    while not live.isEmpty():
        width *= growth
        split = live.select(
            "doc_id", "rid", "gid", "head", "sha",
            F.expr(f"substring(rest, 1, {width})").alias("digit"),
            F.expr(f"substring(rest, {width + 1})").alias("rest"),
            F.greatest(F.col("left") - width, F.lit(0)).alias("left"),
        )
        groups = (
            split.groupBy("gid", "head", "digit")
            .agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "rid")).alias("top"))
            .filter("n > 1")
        )
        level = keep(
            split.join(groups, ["gid", "head", "digit"], "left").select(
                "doc_id", "rid", "sha", "left", "n", "top", F.when(F.col("n") > 1, F.col("rest")).alias("rest")
            ),
            "radix",
        )
        ended = F.col("n").isNull() | (F.col("left") == 0)
        done.append(
            level.filter(ended).select(
                "doc_id",
                F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
                F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
                (F.col("n").isNull() | (F.col("rid") == F.col("top.rid"))).alias("kept"),
                "sha",
            )
        )
        live = level.filter(~ended).select(
            "doc_id", "rid", F.col("top.rid").alias("gid"), F.lit("").alias("head"), "sha", "left", "rest"
        )
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("sha", "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the row with the largest doc_id.

    Rows with a null doc_id are compared like all others; of rows that repeat both
    doc_id and text, one stays. Columns of any name pass.
    """
    doc, sha = free(docs, "doc", "sha")
    found = keep(copy_groups(docs).select(F.struct("doc_id").alias(doc), "kept", F.col("text_sha256").alias(sha)), "copies")
    by_id = keep(found.groupBy(doc).agg(F.count("*").alias("c"), F.bool_or("kept").alias("some")).filter("c > 1 or not some"), "gone-or-repeated")
    rows = docs.withColumn(doc, F.struct("doc_id"))
    once = rows.join(by_id, doc, "left_anti")
    # rows that repeat a doc_id are told apart by their texts
    repeated = rows.join(by_id.filter("c > 1 and some").select(doc), doc, "left_semi")
    repeated = repeated.withColumn(sha, F.sha2(normalised(F.col("text")).cast("binary"), 256))
    stay = repeated.join(found.filter("kept").select(doc, sha), [doc, sha], "left_semi").dropDuplicates([doc, sha])
    return once.unionByName(stay.drop(sha)).drop(doc)
