"""URL filters: allow and block rules, then a Bloom-filter cascade over hosts.

The cascade's first filter encodes the listed hosts, the second those hosts of
the corpus that the first lets through wrongly, the third the listed hosts that
the second lets through, and so on until a level lets none through. As all hosts
of the corpus take part when it is built, the answer for each of them is exact,
and judging a page needs no join: each filter is one row of 64-bit words that a
scalar subquery hands to every task.

Only distinct hosts take part in building, so a host with a third of all pages
costs no more than any other. A level of more than ``PART_BITS`` bits is made of
several filters, and a hash of the host says which one holds it, so no row and no
task that builds one grows with the list. Together the levels take about twice
``bits_per_key`` bits for each listed host of the corpus in every executor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescan.llm.exact_dedup import LOWER, UPPER
from citescan.session import keep

#: bits of one filter: two million bytes
PART_BITS = 1 << 24

#: verdict, host, path
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; equally long ones: the longer host."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(say)).otherwise(verdict)
    return text, verdict


def _places(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits)) for i in range(hashes)]


def _filter_row(keys: DataFrame, level: int, hashes: int, bits: int) -> DataFrame:
    """One row: the filter's words in order."""
    spark, words = keys.sparkSession, bits // 64
    at = F.explode(F.array(*_places(F.col("key"), level, hashes, bits))).alias("at")
    ones = keys.select(at).select((F.col("at") / 64).cast("long").alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
    ones = ones.groupBy("w").agg(F.bit_or("b").alias("b"))
    dense = spark.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b")).unionByName(ones)
    row = dense.groupBy("w").agg(F.bit_or("b").alias("b")).groupBy().agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("x"))
    return row.select(F.transform("x", lambda e: e["b"]).alias("words"))


def _passes(words: Column, key: Column, level: int, hashes: int, bits: int) -> Column:
    out = F.lit(True)
    for at in _places(key, level, hashes, bits):
        word = F.get(words, (at / 64).cast("int"))
        out = out & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


class Level:
    """One level of a cascade: filters of at most ``part_bits`` bits over a hash of the key."""

    def __init__(self, keys: DataFrame, n: int, number: int, hashes: int, bits_per_key: int, part_bits: int):
        self.number, self.hashes = number, hashes
        bits = 64 << max(0, math.ceil(math.log2(max(1.0, n * bits_per_key / 64))))
        self.bits = min(bits, part_bits)
        self.parts = bits // self.bits
        of = self._part(F.col("key"))
        self.words = [keep(_filter_row(keys.filter(of == p), number, hashes, self.bits), f"bloom-{number}-{p}") for p in range(self.parts)]

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("part"), F.lit(self.number), key), F.lit(self.parts))

    def passes(self, key: Column) -> Column:
        one = [_passes(w.scalar(), key, self.number, self.hashes, self.bits) for w in self.words]
        out = one[0]
        for p in range(1, self.parts):
            out = F.when(self._part(key) == p, one[p]).otherwise(out)
        return out


class Cascade:
    """Exact membership of the corpus's keys in a list."""

    def __init__(self, universe: DataFrame, listed: DataFrame, bits_per_key: int = 10, hashes: int = 5, part_bits: int = PART_BITS):
        """``universe`` and ``listed``: a column ``key`` each, distinct; ``listed`` is part of ``universe``. ``part_bits``: a power of 2 from 64 on."""
        self.levels: list[Level] = []
        inside, outside = listed, universe.join(listed, "key", "left_anti")
        while (n := inside.count()) > 0:
            level = Level(inside, n, len(self.levels), hashes, bits_per_key, part_bits)
            self.levels.append(level)
            wrong = keep(outside.filter(level.passes(F.col("key"))), f"wrong-{level.number}")
            inside, outside = wrong, inside

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first level that does not pass it decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(~level.passes(key), F.lit(level.number % 2 == 1)).otherwise(out)
        return out


def url_filter(pages: DataFrame, rules: list[Rule], blocked_domains: list[str] | DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), listed.

    A rule's verdict holds; without a rule a page is blocked if its host is a
    blocked domain or a subdomain of one. A null url, or one without ``://``, has an
    empty host and path and is allowed unless "" is blocked. Repeated rows are judged
    each for itself; other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    hosts = keep(pages.select(host_of(F.col("url")).alias("key")).distinct(), "hosts")
    if isinstance(blocked_domains, list):
        blocked_domains = spark.range(1).select(F.explode(F.lit(blocked_domains).cast("array<string>")).alias("domain"))
    labels = F.split("key", "\\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(F.split("key", "\\."), -i, i), "."))
    tails = hosts.select("key", F.explode(tails).alias("domain"))
    listed = keep(tails.join(blocked_domains.select("domain").distinct(), "domain", "left_semi").select("key").distinct(), "listed")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", text).withColumn("by_rule", verdict)
    rows = rows.withColumn("listed", Cascade(hosts, listed).contains(F.col("host")))
    verdict = F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")
