"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source has a target number of words. Its documents, ordered by a seeded
hash, form a stream that is cut into blocks; the mix takes the first blocks of
the stream, going round again where the target exceeds the source. A binary tree
over the output shards splits the exact block quotas of all sources: a node's
blocks are dealt to its halves as a draw without replacement would deal them, so
each leaf knows how many blocks of each source it gets and no two leaves share
one. Within a shard a hash gives the order.

Everything is DataFrame operations. Prefix sums over a source run in two steps,
by hash bucket and within a bucket, so that a source with a third of all rows is
spread over many tasks.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citescan.llm.names import free
from citescan.session import keep

WORD = r"[^\x20\x09-\x0D]+"
#: rows of a hash bucket, on average
BUCKET_ROWS = 2048
#: standard deviation above which a draw is made by rejection, not by inversion; both are of the same distribution
INVERTED_SD = 20
#: tries of a rejection; each fails with a chance below 0.45
TRIES = 64


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) from a hash of the keys."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, cycle: tuple[int, ...], cap: float) -> DataFrame:
    """source, source_size → with sid, weight, target: weights share all words, none above ``cap`` times its source."""
    everyone = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    out = sizes.withColumn("sid", rank).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), F.pmod(F.col("sid") - 1, F.lit(len(cycle))) + 1)
    )
    out = out.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    out = out.withColumn("level", level)
    # the first source, by ratio, that the level does not fill to its cap sets the level for all
    out = out.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(everyone)["level"])
    return out.select("source", "sid", "source_size", F.least(F.col("weight") * F.coalesce("level", "ratio"), F.col("most")).alias("target"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_factorial(n: Column) -> Column:
    """ln n! of a whole number: Stirling's series, from 10 up by the recurrence."""
    x = n.cast("double") + 10.0
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    product = F.lit(1.0)
    for i in range(1, 11):
        product = product * (n.cast("double") + float(i))
    return series - F.log(product)


def hypergeometric(uniform_of, total: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``marked`` among ``total`` are in a draw of ``drawn``.

    ``uniform_of(name, i)`` is a number in (0, 1) for each name and whole number.
    Narrow distributions are inverted from their first value on; wide ones are drawn
    by the ratio of uniforms, in whose rectangle a point under the curve is sought.
    """
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - marked))
    high = F.least(marked, drawn)
    mean = drawn.cast("double") * marked / F.greatest(total, F.lit(1))
    var = mean * (1 - marked / F.greatest(total, F.lit(1))) * (total - drawn) / F.greatest(total - 1, F.lit(1))

    def inverted(c: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            """The weight of x from that of x - 1."""
            up = (c["marked"] - x + 1).cast("double") * (c["drawn"] - x + 1)
            down = x.cast("double") * (c["total"] - c["marked"] - c["drawn"] + x)
            return F.when(x == c["first"], F.lit(1.0)).otherwise(a["p"] * up / down)

        def add(a: Column, x: Column) -> Column:
            return let(step(a, x), lambda p: F.struct(p.alias("p"), (a["sum"] + p).alias("sum")))

        def find(a: Column, x: Column) -> Column:
            return let(
                step(a, x),
                lambda p: F.struct(
                    p.alias("p"),
                    (a["sum"] + p).alias("sum"),
                    a["goal"].alias("goal"),
                    F.coalesce(a["x"], F.when(a["sum"] + p >= a["goal"], x)).alias("x"),
                ),
            )

        xs = F.sequence(c["first"], c["last"])
        zero, one = F.lit(0.0), F.lit(1.0)
        whole = F.aggregate(xs, F.struct(one.alias("p"), zero.alias("sum")), add)["sum"]
        state = F.struct(one.alias("p"), zero.alias("sum"), (uniform_of("u", F.lit(0)) * whole).alias("goal"), F.lit(None).cast("long").alias("x"))
        return F.coalesce(F.aggregate(xs, state, find)["x"], c["last"])

    def weight(c: Column, x: Column) -> Column:
        """ln of what the chance of x is in proportion to."""
        parts = (x, c["marked"] - x, c["drawn"] - x, c["total"] - c["marked"] - c["drawn"] + x)
        return -sum((log_factorial(p) for p in parts[1:]), log_factorial(parts[0]))

    def rejected(c: Column) -> Column:
        mode = F.floor((c["drawn"] + 1).cast("double") * (c["marked"] + 1) / (c["total"] + 2)).cast("long")
        wide = math.sqrt(8 / math.e) * F.sqrt(c["sd"] * c["sd"] + 0.5) + (3 - 2 * math.sqrt(3 / math.e))

        def tried(m: Column) -> Column:
            def one(i: Column) -> Column:
                u = uniform_of("x", i)
                x = F.floor(c["mean"] + 0.5 + wide * (uniform_of("y", i) - 0.5) / u).cast("long")
                inside = (x >= c["low"]) & (x <= c["high"])
                return let(x, lambda v: F.when(inside, F.when(2 * F.log(u) <= weight(c, v) - m["w"], v)))

            got = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("long"), lambda a, i: F.coalesce(a, one(i)))
            return F.coalesce(got, m["x"])

        return let(mode, lambda x: let(F.struct(x.alias("x"), weight(c, x).alias("w")), tried))

    def bounded(c: Column) -> Column:
        first = F.greatest(c["low"], F.floor(c["mean"] - 8 * c["sd"] - 2).cast("long"))
        last = F.least(c["high"], F.ceil(c["mean"] + 8 * c["sd"] + 2).cast("long"))
        names = ("low", "high", "mean", "sd", "total", "marked", "drawn")
        some = F.struct(*[c[n].alias(n) for n in names], first.alias("first"), F.greatest(first, last).alias("last"))
        return F.when(c["sd"] > INVERTED_SD, rejected(c)).otherwise(let(some, inverted))

    known = F.struct(
        low.alias("low"), high.alias("high"), mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"),
        total.alias("total"), marked.alias("marked"), drawn.alias("drawn"),
    )
    return let(known, bounded)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """sid, blocks → sid, shard, blocks: exact quotas of every shard, by a binary tree over the shards."""
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("sid", "blocks"))).alias("q")).select(
        F.lit(0).alias("lo"), F.lit(shards).alias("n"), "q"
    )
    total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["blocks"])
    half = F.floor(F.col("n") / 2).cast("int")
    to_left = F.floor(F.col("total") * F.col("half") / F.col("n")).cast("long")

    def deal(acc: Column, x: Column) -> Column:
        def uniform_of(name: str, i: Column) -> Column:
            return uniform(F.lit(name), i, F.lit(seed), F.col("lo"), F.col("n"), x["sid"])

        return let(
            hypergeometric(uniform_of, acc["rest"], x["blocks"], acc["want"]),
            lambda got: F.struct(
                (acc["rest"] - x["blocks"]).alias("rest"),
                (acc["want"] - got).alias("want"),
                F.concat(acc["got"], F.array(got)).alias("got"),
            ),
        )

    start = F.struct(F.col("total").alias("rest"), F.col("to_left").alias("want"), F.expr("cast(array() as array<bigint>)").alias("got"))
    left = F.aggregate("q", start, deal)["got"]
    mine = F.zip_with("q", "left", lambda x, g: F.struct(x["sid"].alias("sid"), g.alias("blocks")))
    rest = F.zip_with("q", "left", lambda x, g: F.struct(x["sid"].alias("sid"), (x["blocks"] - g).alias("blocks")))
    parts = F.when(
        F.col("n") > 1,
        F.array(
            F.struct(F.col("lo").alias("lo"), F.col("half").alias("n"), mine.alias("q")),
            F.struct((F.col("lo") + F.col("half")).alias("lo"), (F.col("n") - F.col("half")).alias("n"), rest.alias("q")),
        ),
    ).otherwise(F.array(F.struct("lo", "n", "q")))
    for _ in range(math.ceil(math.log2(max(shards, 1)))):
        node = node.withColumns({"total": total, "half": half}).withColumn("to_left", to_left)
        # the generator between two columns keeps the deal from being worked out once for each half
        node = node.withColumn("left", F.explode(F.array(left)))
        node = node.select(F.explode(parts).alias("x")).select("x.*")
    return node.select(F.col("lo").alias("shard"), F.explode("q").alias("x")).select("shard", "x.sid", "x.blocks")


def _pieces(epoch: int, block_words: int, seed: int) -> Column:
    """What the shards take of a document when its source's stream goes round for the ``epoch``-th time."""
    lo = F.col("at") + epoch * F.col("source_size")
    hi = F.least(lo + F.col("size"), F.col("quota"))

    def start(b: Column) -> Column:
        return F.greatest(lo, b["lo"] * block_words)

    def stop(b: Column) -> Column:
        return F.least(hi, b["hi"] * block_words)

    near = F.filter(F.coalesce("bounds", F.expr("array()")), lambda b: start(b) < stop(b))
    return F.transform(
        near,
        lambda b: F.struct(
            b["shard"].alias("shard"),
            F.lit(epoch).alias("epoch"),
            (start(b) - lo).alias("first_word"),
            (stop(b) - start(b)).alias("n_words"),
            F.xxhash64(F.lit(seed), b["shard"], F.lit(epoch), F.col("doc_id"), start(b)).alias("place"),
        ),
    )


def mix(
    docs: DataFrame,
    cycle: tuple[int, ...] = (1, 2, 3),
    cap: float = 3.0,
    shards: int = 16,
    block_words: int = 64,
    seed: int = 11,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, copy, size, source, source_size, target, taken, pieces.

    ``pieces`` are the parts of the document that the mix takes: shard, epoch, the
    first word, the number of words and the place within the shard. ``copy`` numbers
    the rows that share doc_id, source, size and ``text_hash``, so reruns agree however the rows are dealt out. Null text has no words; a null source is a source
    of its own, after all others; a source without words has target 0. An empty
    table gives an empty result. Other columns are ignored.
    """
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = keep(
        docs.select("doc_id", "source", words.alias("size"), F.xxhash64("text").alias("text_hash")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "text_hash")),
        "mix-sizes",
    )
    plan = keep(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, cap), "mix-targets")
    plan = plan.withColumn("quota", F.least(F.round("target"), F.floor(F.lit(float(cap)) * F.col("source_size"))).cast("long"))
    quotas = plan.select("sid", F.ceil(F.col("quota") / block_words).cast("long").alias("blocks"))
    dealt = split_quotas(quotas, shards, seed)
    upto = F.sum("blocks").over(Window.partitionBy("sid").orderBy("shard"))
    bounds = (
        dealt.withColumn("upto", upto)
        .filter("blocks > 0")
        .groupBy("sid")
        .agg(F.sort_array(F.collect_list(F.struct((F.col("upto") - F.col("blocks")).alias("lo"), F.col("upto").alias("hi"), "shard"))).alias("bounds"))
    )
    plan = keep(plan.join(bounds, "sid", "left"), "mix-plan")
    known = plan.withColumnRenamed("source", "_source")
    bits = max(1, math.ceil(math.log2(max(2, rows.count() / BUCKET_ROWS))))
    # _plan's own name for the source, so that null matches null
    rows = rows.join(known, rows["source"].eqNullSafe(known["_source"])).drop("_source").withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("b"))
    base = F.coalesce(F.sum("b").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    sums = sums.select("sid", "bucket", base.alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "text_hash")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    same = Window.partitionBy("sid", "doc_id", "size", "text_hash").orderBy("at")
    rows = rows.join(sums, ["sid", "bucket"]).withColumn("at", F.col("base") + before).withColumn("copy", F.row_number().over(same))
    found = [_pieces(epoch, block_words, seed) for epoch in range(math.ceil(cap))]
    return rows.withColumn("pieces", F.concat(*found)).select(
        "doc_id", "text_hash", "copy", "size", "source", "source_size", "target",
        F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["n_words"]).alias("taken"),
        "pieces",
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per taken piece of a document, repeats included.

    A piece that is a whole document keeps its text as it is; another piece is the
    text from its first to its last word with the white space between. Of rows that
    share doc_id and source, each takes its own pieces. Columns of any name pass.
    """
    doc, source, hashed, copy, size, pieces, place, piece = free(docs, "doc", "source", "hashed", "copy", "size", "pieces", "place", "piece")
    named = {"doc_id": doc, "source": source, "text_hash": hashed, "copy": copy, "size": size, "pieces": pieces}
    plan = mix(docs, **options).filter("size(pieces) > 0").select(*[F.col(c).alias(name) for c, name in named.items()])
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rest = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "source", "text")]
    alike = Window.partitionBy("doc_id", "source", words, F.xxhash64("text")).orderBy(*rest, F.lit(0))
    rows = docs.withColumn(place, F.row_number().over(alike))
    same = [rows["doc_id"].eqNullSafe(plan[doc]), rows["source"].eqNullSafe(plan[source]), words == plan[size], F.xxhash64("text") == plan[hashed], rows[place] == plan[copy]]
    on = functools.reduce(lambda a, b: a & b, same)
    units = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))

    def texts(split: Column) -> Column:
        part = lambda p: F.concat_ws("", F.slice(split, p["first_word"].cast("int") + 1, p["n_words"].cast("int")))
        return F.transform(pieces, lambda p: F.when(p["n_words"] == F.col(size), F.col("text")).otherwise(part(p)))

    # a text is split once, for all of its pieces
    out = rows.join(plan, on).withColumn(piece, F.explode(F.flatten(F.transform(F.array(units), texts)))).withColumn("text", F.col(piece))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text"))
    return out.select(*docs.columns)
