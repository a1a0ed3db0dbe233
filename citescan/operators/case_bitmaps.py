"""An index of cases for descriptions: by court, year and rapporteur, with bitmaps of the cases that rapporteurs share.

A description leaves open what it does not tell, and its name may mean several
registered ones, so the cases that fit are a union. Cases with one rapporteur
only are in one list of it and are added up; those with several are numbered,
64 to a word, and their words are or-ed before bits are counted. A question thus
meets names and words, not cases.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescan.session import keep


class Index(NamedTuple):
    #: k, n, menor_id: all cases of what is told of court and year
    told: DataFrame
    #: k, nome, n, sole, menor_id: cases of a rapporteur, and those that have no other
    names: DataFrame
    #: k, nome, word, bits: the rapporteur's cases among the numbered ones
    shared: DataFrame


def key(court: Column, year: Column) -> Column:
    """What is told of court and year; "" and 0 where it is not."""
    return F.struct(F.coalesce(court, F.lit("")).alias("t"), F.coalesce(year, F.lit(0)).alias("a"))


def build(cases: DataFrame) -> Index:
    """The index of cases (tribunal, numero, registros, menor_id), a row for each case; its tables are kept.

    Year and rapporteur may be of different records of a case. Nameless records
    count for the year; a case without records is in no list.
    """
    years = F.array_distinct(F.transform("registros", lambda r: r["ano"]))
    asked = F.flatten(F.transform(years, lambda y: F.array(*[key(t, a) for t in (F.col("tribunal"), F.lit(None)) for a in (y, F.lit(None))])))
    nomes = F.array_sort(F.array_distinct(F.filter(F.transform("registros", lambda r: r["relator"]), lambda n: n.isNotNull() & (n != ""))))
    facts = keep(cases.select("tribunal", "numero", "menor_id", F.array_distinct(asked).alias("ks"), nomes.alias("nomes")), "facts")
    told = facts.select("menor_id", F.explode("ks").alias("k")).groupBy("k").agg(F.count("*").alias("n"), F.min("menor_id").alias("menor_id"))
    lists = facts.select("menor_id", "nomes", F.explode("ks").alias("k")).select("menor_id", (F.size("nomes") == 1).alias("one"), "k", F.explode("nomes").alias("nome"))
    names = lists.groupBy("k", "nome").agg(F.count("*").alias("n"), F.count_if("one").alias("sole"), F.min("menor_id").alias("menor_id"))
    # cases of the same rapporteurs stand side by side, so that they share words; the numbers stay as they are written
    order = facts.filter(F.size("nomes") > 1).orderBy("nomes", "tribunal", "numero")
    order = keep(order.select("ks", "nomes", F.monotonically_increasing_id().alias("place")), "places")
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    places = order.select(F.explode("ks").alias("k"), "nomes", F.expr("place div 64").alias("word"), bit.alias("bit"))
    shared = places.select("k", F.explode("nomes").alias("nome"), "word", "bit").groupBy("k", "nome", "word").agg(F.bit_or("bit").alias("bits"))
    return Index(keep(told, "told"), keep(names, "names"), keep(shared, "shared"))


class Meetings(NamedTuple):
    #: key, k, nome, n, sole, menor_id: a row for each name that a question may mean and that has cases
    names: DataFrame
    #: key, word, bits: words of questions that mean several names
    words: DataFrame


def meetings(asked: DataFrame, links: DataFrame, index: Index) -> Meetings:
    """What questions (key, k, relator) meet in the index; ``links`` are relator and nome."""
    names = asked.filter("relator is not null").join(links, "relator").select("key", "k", "nome").join(index.names, ["k", "nome"])
    names = keep(names, "meant")
    several = names.groupBy("key").agg(F.count_if(F.col("n") > F.col("sole")).alias("lists")).filter("lists > 1").select("key")
    words = names.join(several, "key", "left_semi").join(index.shared, ["k", "nome"]).select("key", "word", "bits")
    return Meetings(names, words)


def counted(asked: DataFrame, links: DataFrame, index: Index) -> DataFrame:
    """key, n, id: how many cases fit each question (key, k, relator), and the smallest id of them; none: no row."""
    met = meetings(asked, links, index)
    # of one list the count stands; cases of several lists are counted by their bits
    sums = met.names.groupBy("key").agg(F.sum("n").alias("all"), F.sum("sole").alias("sole"), F.min("menor_id").alias("id"))
    bits = met.words.groupBy("key", "word").agg(F.bit_or("bits").alias("bits")).groupBy("key").agg(F.sum(F.bit_count("bits").cast("long")).alias("bits"))
    named = sums.join(bits, "key", "left").select("key", F.coalesce(F.col("sole") + F.col("bits"), F.col("all")).alias("n"), "id")
    open_ = asked.filter("relator is null").select("key", "k").join(index.told, "k").select("key", "n", F.col("menor_id").alias("id"))
    return named.union(open_)
