"""A run evaluates and writes only what there is."""

import os

import pytest

from citescan.operators.canonical import RECORD
from citescan.plans import runs
from citescan.sources import documents

TEXT = "Vistos.\n\n\nConforme o REsp 1.234.567/SP, e o REsp 9.999.999/SP, nada mais."


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("snapshot")
    docs = spark.createDataFrame([("doc_n1_1", TEXT), ("doc_n2_2", "Vistos.\n\n\nNada se cita.")], "documento_id string, texto string")
    documents.write_texts(docs, str(folder / "txt"))
    documents.write_base(spark.createDataFrame([(7, "b7", "STJ", 2001, "Min. Ana Lima", "acordao", "acordao", "REsp 1.234.567/SP\nEMENTA.")], RECORD), str(folder / "base.db"))
    first, second = TEXT.index("REsp 1"), TEXT.index("REsp 9")
    rows = [f"1,doc_n1_1,g1,{first},{first + 17},REsp 1.234.567/SP,jurisprudencia,real,7", f"1,doc_n1_1,g2,{second},{second + 17},REsp 9.999.999/SP,jurisprudencia,inventada,", "1,not_read,g3,0,5,x,lei,real,1"]
    (folder / "goldenset.csv").write_text("﻿nivel,documento_id,citacao_id,inicio,fim,trecho,tipo,classificacao,id_canonico\n" + "\n".join(rows) + "\n", encoding="utf-8")
    return folder


def test_with_base_and_annotations_all_is_told_and_written(spark, snapshot, tmp_path):
    made = runs.run(spark, runs.Profile.of(str(snapshot), str(snapshot / "base.db")), str(tmp_path / "out"), exact=True)
    assert tuple(made.totals.first()) == (2, 2)
    assert {(r.nivel, r.documentos) for r in made.levels.collect()} == {(1, 1), (2, 1)}
    total = made.reports["extraction"].filter("documento_id is null").first()
    assert (total.tp, total.fp, total.fn) == (2, 0, 0)  # a document that was not read does not count
    assert sorted(made.reports) == ["calibration", "classification", "extraction", "official", "official_levels"]
    classes = {r.classe: (r.tp, r.fp, r.fn) for r in made.reports["classification"].collect()}
    assert classes["real"] == (1, 0, 1) and classes["inventada"] == (1, 0, 0)
    assert sorted(os.listdir(tmp_path / "out" / "json")) == ["doc_n1_1.json", "doc_n2_2.json"]
    rows = {r.documento_id: r.citacoes for r in spark.read.csv(str(tmp_path / "out" / "csv"), header=True).collect()}
    assert rows["doc_n2_2"] == "-" and ",real,7," in rows["doc_n1_1"] and ",inventada,-," in rows["doc_n1_1"]
    with pytest.raises(FileExistsError):
        runs.run(spark, runs.Profile.of(str(snapshot), str(snapshot / "base.db")), str(tmp_path / "out"))


def test_without_a_base_nothing_is_decided_or_written(spark, snapshot, tmp_path):
    made = runs.run(spark, runs.Profile(str(snapshot / "txt"), str(snapshot / "goldenset.csv")), str(tmp_path / "out"), calibrated=True)
    assert made.citations.count() == 2 and made.results is None and made.totals is None and made.written is None
    assert list(made.reports) == ["extraction"] and not os.path.exists(tmp_path / "out")


def test_without_annotations_nothing_is_evaluated(spark, snapshot):
    made = runs.run(spark, runs.Profile(str(snapshot / "txt"), base=str(snapshot / "base.db")), calibrated=True)
    assert made.reports == {} and tuple(made.totals.first()) == (2, 2) and made.written is None
