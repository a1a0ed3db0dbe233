"""The citation operators on small texts and tables of their own."""

import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from citescan.functions import norm as N
from citescan.operators import canonical, evaluate, extract, perturb, resolve, synth
from citescan.operators import grammar as G
from citescan.plans import pipeline
from citescan.sources import documents, results


def one(spark, value, *columns):
    row = spark.createDataFrame([(value,)], "x string").select(*[c.alias(str(i)) for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def spans(spark, text, generic=False):
    docs = spark.createDataFrame([("d", text)], "documento_id string, texto string")
    (row,) = extract.detect(docs, generic).collect()
    for c in row["citacoes"]:
        assert text[c["inicio"] : c["fim"]] == c["trecho"]
    return [(c["padrao"], c["trecho"]) for c in row["citacoes"]]


BODY = "CAB\n\n\n"
N_DIGITS = re.compile("[^0-9]")


@pytest.mark.parametrize(
    "text,want",
    [
        ("Conforme o REsp 1.741.784/SP, provido", [("processo", "REsp 1.741.784/SP")]),
        ("no Agravo Interno no Rec. Esp. nº 1.45g.779 - RJ.", [("processo", "Agravo Interno no Rec. Esp. nº 1.45g.779 - RJ")]),
        ("a Súmula 83 do STJ e a SV 10", [("sumula", "Súmula 83 do STJ"), ("sumula", "SV 10")]),
        ("o verbete nº 7 da Súmula do STJ", [("sumula", "verbete nº 7 da Súmula do STJ")]),
        ("Tema 339 da repercussão geral; OJ 191 da SDI-1", [("tema", "Tema 339 da repercussão geral"), ("orientacao_jurisprudencial", "OJ 191 da SDI-1")]),
        ("art. 5º, § 1º, II, da Constituição Federal", [("dispositivo_legal", "art. 5º, § 1º, II, da Constituição Federal")]),
        ("o 0001234-56.2019.5.02.0031 foi", [("numero_cnj", "0001234-56.2019.5.02.0031")]),
        ("julgado do STJ de 2019, da relatoria de Ana Barroso", [("decisao_descritiva", "julgado do STJ de 2019, da relatoria de Ana Barroso")]),
        ("a Súmula 83\ndo STJ", [("sumula", "Súmula 83\ndo STJ")]),
        ("nada aqui", []),
    ],
)
def test_patterns(spark, text, want):
    assert spans(spark, BODY + text) == want


def test_generic_patterns_on_request(spark):
    text = BODY + "a pacífica jurisprudência do STJ e a legislação aplicável à espécie"
    assert spans(spark, text) == []
    assert [p for p, _ in spans(spark, text, generic=True)] == ["jurisprudencia_generica", "legislacao_generica"]


@pytest.mark.parametrize(
    "text,start",
    [("a\n\n\nb", 4), ("a\r\n \r\n\t\r\nb", 9), ("a\n \nb", 4), ("x" * 1500 + "\n\nb", 0), ("x" * 1600 + "\n\n\nb", 1603), ("ab", 0), ("", 0)],
)
def test_body_start(spark, text, start):
    assert one(spark, text, extract.body_start(F.col("x"))) == start


def test_overlaps_keep_the_earliest_then_the_longest(spark):
    span = "array<struct<inicio:int,size:int,ordem:int,trecho:string,tipo:string,padrao:string>>"
    rows = [(5, -15, 0), (0, -10, 1), (12, -3, 2), (0, -4, 0), (30, -2, 3), (30, -2, 1)]
    df = spark.createDataFrame([([(*r, "", "", str(r[2])) for r in rows],)], f"s {span}")
    got = df.select(extract.without_overlaps(F.col("s"))).first()[0]
    assert [(c["inicio"], c["fim"], c["padrao"]) for c in got] == [(0, 10, "1"), (12, 15, "2"), (30, 32, "1")]


def test_native_spans_count_code_points(spark):
    got = one(spark, "\U0001f600 12 é 3", extract.native_spans(F.col("x"), "[0-9]+"))
    assert [(s["inicio"], s["fim"]) for s in got] == [(2, 4), (7, 8)]


@pytest.mark.parametrize(
    "text,key,segment",
    [("1.45g.779", "1459779", None), ("0001234-56.2019.5.02.0031", "1234-5620195020031", "5"), ("000", "0", None), ("abc!", "6", None), ("x-y", None, None), ("7000171-3920237000000", "7000171-3920237000000", "7")],
)
def test_number_keys(spark, text, key, segment):
    got = N.number_key(F.col("x"))
    assert one(spark, text, got, N.cnj_segment(got)) == (key, segment)


def test_names_courts_and_laws(spark):
    assert one(spark, "Min. JOSÉ  d'Ávila-Conceição", N.person(F.col("x"))) == "jose d avila conceicao"
    assert one(spark, "do STJ e do STF", N.court_mentioned(F.col("x"))) == "STF"
    assert one(spark, "codigo de processo penal militar", N.law_of(F.col("x"))) == "CPP"
    assert one(spark, "REsp 1 (SP)", N.uf_at_end(F.col("x"))) == "SP"
    same = N.same_person(F.element_at(F.split("x", "/"), 1), F.element_at(F.split("x", "/"), 2))
    assert [one(spark, x, same) for x in ("ana barrozo/ana barroso", "ana/bia costa", "de/ana", "barros/barross x")] == [True, False, False, True]


RECORDS = [
    (10, "a", "STJ", 2019, "Min. Ana Barroso", "acordao", "t", "REsp 1.741.784/SP\nEMENTA"),
    (11, "b", "STJ", 2020, "Bento Cardoso", "acordao", "t", "EDcl no REsp 1.741.784 - SP\nEMENTA"),
    (12, "c", "STF", 2019, "Min. Clara Dantas", "acordao", "t", "Rcl 1.741.784/RJ\nEMENTA"),
    (13, "d", "TST", 2018, None, "acordao", "t", "Vistos os autos do RR-1234-56.2018.5.02.0031, em que"),
    (14, "e", None, 2018, None, "acordao", "t", "REsp 999.999/SP"),
    (20, "f", None, None, None, "sumula", "t", "Súmula nº 83 do STJ\nNão se conhece"),
    (21, "g", None, None, None, "sumula", "t", "Viola a CLÁUSULA de reserva   de plenário a decisão"),
    (22, "h", None, None, None, "sumula", "t", "Súmula n. 83 do STJ"),
    (30, "i", None, None, None, "dispositivo", "t", "Artigo 373 do Código de Processo Civil\nO ônus"),
]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame(RECORDS, canonical.RECORD)


DECISIONS = [
    ("REsp 1.741.784/SP", ("real", 10, "processo_real")),
    ("EDcl no REsp 1.741.784/SP", ("real", 11, "processo_real")),
    ("RE 1.741.784", ("real", 12, "processo_real")),
    ("HC 1.741.784/RJ", ("real", 12, "processo_real")),
    ("HC 1.741.784", ("incompleta", None, "processo_ambiguo")),
    ("REsp 1.741.78S", ("inventada", None, "processo_inventado_ocr")),
    ("REsp 1.741.785", ("inventada", None, "processo_inventado")),
    ("RR-0001234-56.2018.5.02.0031/SP", ("real", 13, "processo_real")),
    ("Súmula 83 do STJ", ("real", 22, "sumula_real")),
    ("Súmula Vinculante 10", ("real", 21, "sumula_real")),
    ("Súmula 83 do TST", ("inventada", None, "sumula_inventada")),
    ("art. 373 do CPC", ("real", 30, "artigo_real")),
    ("art. 374 do CPC", ("inventada", None, "artigo_inexistente")),
    ("art. 374 da Lei 9.999/99", ("inventada", None, "artigo_lei_fora")),
    ("julgado do STJ de 2019, da relatoria de Ana Barrozo", ("real", 10, "descricao_unica")),
    ("julgado do STJ de 2020, da relatoria de Ana Barroso", ("real", 10, "descricao_unica")),
    ("julgado do STJ de 2017, da relatoria de Ana Barroso", ("incompleta", None, "descricao_sem_correspondencia")),
    ("Tema 339 do STF", ("inventada", None, "tema_oj")),
]


def test_decisions(spark, base):
    docs = spark.createDataFrame([(t, f"{BODY}Segundo o {t}; assim.") for t, _ in DECISIONS], "documento_id string, texto string")
    rows = pipeline.run(docs, base, confidence=pipeline.calibrated()).collect()
    assert {r["documento_id"]: (r["classificacao"], r["id_canonico"], r["regra"]) for r in rows} == dict(DECISIONS) and len(rows) == len(DECISIONS)
    assert all((r["id_canonico"] is not None) == (r["classificacao"] == "real") and r["motivo"].startswith(r["regra"] + ": ") for r in rows)


def test_without_a_base_citations_are_only_found(spark):
    docs = spark.createDataFrame([("d", BODY + "REsp 12.345"), ("e", None)], "documento_id string, texto string")
    assert pipeline.run(docs, None).columns == ["documento_id", "n", "inicio", "fim", "trecho", "tipo", "padrao"]


def test_sources_and_results_round_trip(spark, tmp_path):
    folder = tmp_path / "txt"
    folder.mkdir()
    (folder / "b_n1_1.txt").write_bytes("CAB\r\n\r\n\r\nREsp 1.741.784/SP é".encode())
    (folder / "a.txt").write_bytes(b"x")
    (folder / "other.md").write_bytes(b"x")
    docs = documents.read_texts(spark, str(folder))
    assert {r["documento_id"]: r["texto"] for r in docs.collect()} == {"b_n1_1": "CAB\r\n\r\n\r\nREsp 1.741.784/SP é", "a": "x"}
    with sqlite3.connect(tmp_path / "base.db") as db:
        db.execute("CREATE TABLE documentos (id INTEGER PRIMARY KEY, documento_id, tribunal, ano, relator, natureza, tipo, texto)")
        db.executemany("INSERT INTO documentos VALUES (?, ?, ?, ?, ?, ?, ?, ?)", RECORDS)
    base = documents.read_base(spark, str(tmp_path / "base.db"))
    assert sorted(tuple(r) for r in base.collect()) == RECORDS
    with pytest.raises(FileNotFoundError):
        documents.read_base(spark, str(tmp_path / "none.db"))
    found = results.contract(docs, pipeline.run(docs, base))
    out = tmp_path / "out"
    results.write_files(found, str(out))
    again = documents.read_results(spark, str(out))
    assert sorted(results.submission(again).collect()) == sorted(results.submission(found).collect())
    assert {r[0]: r[1] for r in results.submission(found).collect()} == {"a": "-", "b_n1_1": "9,26,real,10,1.0000"}
    results.write_submission(found, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_annotations(spark, tmp_path):
    path = tmp_path / "gold.csv"
    path.write_text("﻿nivel,documento_id,citacao_id,inicio,fim,trecho,tipo,classificacao,id_canonico\n1,d,g1,0,5,a\\nb c,lei,real,1 2\n1,d,g2,0,5,a\\nb c,lei,inventada,\n", encoding="utf-8")
    rows = documents.read_annotations(spark, str(path))
    assert [(r["nivel"], r["trecho"], r["ids_aceitos"]) for r in rows.collect()] == [(1, "a\nb c", [1, 2]), (1, "a\nb c", [])]
    assert documents.gold_spans(rows).count() == 1


def test_matching_ties_go_opposite_ways(spark):
    span = "array<struct<inicio:int,fim:int>>"
    df = spark.createDataFrame([([(0, 10), (10, 20)], [(5, 15), (0, 20)])], f"pred {span}, gold {span}")
    late, early = df.select(evaluate.matched(F.col("pred"), F.col("gold"), 0.3), evaluate.matched(F.col("pred"), F.col("gold"), 0.3, False)).first()
    assert {(m["p"], m["g"]) for m in late} == {(2, 2), (1, 1)} and {(m["p"], m["g"]) for m in early} == {(1, 2), (2, 1)}


PRED = "documento_id string, inicio int, fim int, trecho string, tipo string, classificacao string, id_canonico long, confianca double, motivo string"
GOLD = "documento_id string, inicio int, fim int, trecho string, tipo string, classificacao string, nivel int, ids_aceitos array<long>"


def test_official_score_forgives_parts_of_matched_citations(spark):
    pred = spark.createDataFrame(
        [("d_n1_", 0, 8, "", "lei", "real", 1, 1.0, "a: x"), ("d_n1_", 8, 10, "", "lei", "real", 1, 1.0, "a: x"), ("d_n1_", 50, 60, "", "lei", "real", 9, 1.0, "b: x"), ("e_n2_", 0, 5, "", "lei", "incompleta", None, 0.5, "b: x")], PRED
    )
    gold = spark.createDataFrame([("d_n1_", 0, 10, "", "lei", "real", 1, [1]), ("d_n1_", 50, 60, "", "lei", "real", 1, [2]), ("d_n1_", 90, 95, "", "lei", "inventada", 1, [])], GOLD)
    (level,) = evaluate.official_levels(pred, gold).collect()
    # real: 1 hit, 1 wrong id; inventada: missed; the spare part counts for nothing
    assert (level["nivel"], round(level["macro_f1"], 9), level["tau"]) == (1, round((2 / 3 + 0) / 2, 9), 0.0)
    assert round(level["bonus"], 9) == 0.05
    rules = {r["regra"]: (r["hits"], r["total"]) for r in evaluate.calibration(pred, gold).collect()}
    assert rules == {"a": (1, 1), "b": (0, 1)}


@pytest.mark.parametrize("name", list(perturb.NOISES))
def test_noises_change_one_place(spark, name):
    text = "AgInt no REsp nº 1.741.105 - SP"
    rows = spark.range(20).select(F.lit(text).alias("x"), F.col("id").cast("string").alias("k"))
    got = {r[0] for r in rows.select(perturb.NOISES[name](F.col("x"), F.col("k"))).collect()}
    assert got - {text} and all(extract_once(g) for g in got)


def extract_once(text):
    return len(list(G.compiled("processo").finditer(text))) >= 1


@pytest.mark.parametrize("text", ["REsp 2.222.222", "HC 93434343", "Rcl n. 3333333 - SP", "AgInt no REsp nº 3.443.344 (RJ)", "Recurso Especial nº 2776689/MG"])
def test_ocr_misreads_texts_without_its_common_characters(spark, text):
    rows = spark.range(20).select(F.lit(text).alias("x"), F.col("id").cast("string").alias("k"))
    got = {r[0] for r in rows.select(perturb.ocr(F.col("x"), F.col("k"))).collect()}
    read = str.maketrans("OlSsZGTBg", "015526789")
    assert text not in got and {g.translate(read) for g in got} == {text.translate(read)}


def test_robustness_and_synthesis(spark, base):
    text = BODY + "Conforme o REsp 1.741.784/SP, sim"
    docs = spark.createDataFrame([("d", text)], "documento_id string, texto string")
    at = text.index("REsp")
    gold = spark.createDataFrame([("d", at, at + 17, "REsp 1.741.784/SP"), ("d", 0, 3, "XYZ")], "documento_id string, inicio int, fim int, trecho string")
    got = perturb.robustness(docs, gold).first()
    assert 0 < got["variants"] <= 5 and got["recall"] >= 0.6
    cases = canonical.cases(base).cache()
    decide = lambda c: pipeline.decide(c, base)
    made = synth.real_cases(synth.sampled(cases)).unionByName(synth.invented_cases(cases, cases))
    assert all(r["hits"] == r["total"] for r in synth.judged(made, decide).collect())


def test_invented_numbers_beside_a_base_that_has_all_of_its_length(spark):
    numbers = [str(n) for n in range(1000, 10000)]
    cases = spark.createDataFrame([("STJ", n, ["SP"]) for n in numbers] + [("STJ", "17-12201950200310", [])], "tribunal string, numero string, ufs array<string>")
    made = [r[0] for r in synth.invented_cases(cases.filter("numero like '12%' or numero like '%-%'"), cases).select("texto").collect()]
    cited = [N_DIGITS.sub("", t.split("acolhida")[0].split("/")[0].split(" - ")[0].split(" (")[0]) for t in made if "2019" not in t]
    assert len(cited) == 100 and all(len(n) == 5 for n in cited)
    assert len(made) == 101 and not any("17-12" in t or "0000017-12" in t for t in made)


def test_judged_searches_its_texts_once(spark, base):
    made, plans = synth.real_cases(canonical.cases(base)), []

    def decide(citations):
        plans.append(citations._jdf.queryExecution().toString())
        return pipeline.decide(citations, base)

    assert synth.judged(made, decide).count() == 1
    assert plans and not any("MapInArrow" in p for p in plans)  # what decisions read several times is a table


def test_streams_find_what_batches_find(spark, tmp_path):
    from citescan.streaming import detection

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.txt").write_text(BODY + "REsp 12.345/SP", encoding="utf-8")
    query = detection.write_detected(detection.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    (row,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert (row["documento_id"], row["citacoes"][0]["trecho"]) == ("d", "REsp 12.345/SP")
