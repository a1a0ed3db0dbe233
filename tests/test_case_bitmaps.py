"""Descriptions by the cases' index against all cases, one by one."""

import random

from pyspark.sql import functions as F

from citescan.operators import case_bitmaps, resolve

CASES = "tribunal string, numero string, registros array<struct<id:long,marcas:array<string>,ano:int,relator:string>>, menor_id long"
NAMES = ["ana barroso", "bento barroso", "davi barroso", "clara dantas", "bento dantas", "", None]


def _cases(n: int, seed: int, names=NAMES) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for i in range(n):
        records = [(10 * i + j, [], rng.choice([2018, 2019, 2020, None]), rng.choice(names)) for j in range(rng.randint(0, 4))]
        rows.append((rng.choice(["STF", "STJ"]), str(i), records, 10 * i))
    return rows


def _fitting(cases, court, year, name):
    """Plain reading of every case."""
    means = lambda n: bool(n) and all(w in n.split() for w in name.lower().split())
    return [
        c[3] for c in cases
        if (court is None or c[0] == court) and any(year is None or r[2] == year for r in c[2]) and (name is None or any(means(r[3]) for r in c[2]))
    ]


def _asked():
    for court in ("STF", "STJ", None):
        for year in (2018, 2019, 2021, None):
            for name in ("Barroso", "Bento", "Dantas", "Ana Barroso", "Zuleica", None):
                if court or year or name:
                    said = "".join([f" do {court}" if court else "", f" de {year}" if year else "", f", da relatoria de {name}" if name else ""])
                    yield "julgado" + said, court, year, name


def test_descriptions_equal_a_reading_of_all_cases(spark):
    for n, seed in ((0, 1), (3, 2), (500, 3)):
        cases = _cases(n, seed)
        asked = list(_asked())
        snippets = spark.createDataFrame([(a[0],) for a in asked], "trecho string")
        got = {r["trecho"]: r for r in resolve.by_description(snippets, spark.createDataFrame(cases, CASES)).collect()}
        assert len(got) == len(asked)
        for said, *told in asked:
            fits = _fitting(cases, *told)
            rule = {0: "descricao_sem_correspondencia", 1: "descricao_unica"}.get(len(fits), "descricao_varios")
            row = got[said]
            assert (row["regra"], row["id_canonico"]) == (rule, fits[0] if len(fits) == 1 else None), said
            assert len(fits) < 2 or row["motivo"] == f"{len(fits)} feitos possíveis"


def test_questions_meet_names_and_words_not_cases(spark):
    """All cases share two rapporteurs, and every question tells a name only."""
    cases = spark.range(20000).select(
        F.lit("STJ").alias("tribunal"), F.col("id").cast("string").alias("numero"),
        F.array(*[F.struct(F.col("id"), F.array().cast("array<string>").alias("marcas"), (2000 + F.col("id") % 20).cast("int").alias("ano"), F.lit(n).alias("relator")) for n in ("ana barroso", "bento barroso")]).alias("registros"),
        F.col("id").alias("menor_id"),
    )
    index = case_bitmaps.build(cases)
    letters = "abcdefgh"
    relators = ["barroso"] + ["barros" + x for x in letters] + [x + "barroso" for x in letters]
    asked = spark.createDataFrame([(r,) for r in relators], "relator string").select(
        F.struct(F.lit(None).cast("string").alias("tribunal"), F.lit(None).cast("int").alias("ano"), "relator").alias("key"), case_bitmaps.key(F.lit(None), F.lit(None)).alias("k"), "relator"
    )
    links = resolve.name_links(asked.select("relator"), index.names.select("nome").distinct())
    met = case_bitmaps.meetings(asked, links, index)
    assert met.names.count() == 2 * len(relators)
    assert met.words.count() < len(relators) + 20000
    assert {(r["n"], r["id"]) for r in case_bitmaps.counted(asked, links, index).collect()} == {(20000, 0)}
