"""Files are published by the job's commit; a job that fails leaves the folder as it was."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from citescan.sources import documents, publish, results


def held(folder) -> dict[str, str]:
    return {n: open(os.path.join(folder, n), encoding="utf-8", newline="").read() for n in os.listdir(folder)}


def numbered(spark, n, text="concat('texto ', id, '\\r\\nção')"):
    return spark.range(0, n, 1, 4).selectExpr("concat('d', id, '.txt') AS nome", f"{text} AS conteudo", "id AS outra")


def test_new_joined_and_overwritten_folders(spark, tmp_path):
    folder = str(tmp_path / "out")
    publish.publish(numbered(spark, 20), folder)
    assert held(folder) == {f"d{i}.txt": f"texto {i}\r\nção" for i in range(20)}
    publish.publish(numbered(spark, 2, "IF(id = 0, NULL, 'novo')"), folder)
    assert len(held(folder)) == 20 and held(folder)["d0.txt"] == "" and held(folder)["d1.txt"] == "novo"
    publish.publish(numbered(spark, 1), folder, overwrite=True)
    assert list(held(folder)) == ["d0.txt"]
    publish.publish(numbered(spark, 0), folder, overwrite=True)
    assert held(folder) == {} and os.listdir(tmp_path) == ["out"]


@pytest.mark.parametrize("overwrite", [False, True])
@pytest.mark.parametrize(
    "spoilt",
    [
        lambda f: f.withColumn("conteudo", F.when(F.col("outra") == 19, F.raise_error(F.lit("falha"))).otherwise(F.col("conteudo"))),
        lambda f: f.withColumn("nome", F.when(F.col("outra") == 19, F.lit("d0.txt")).otherwise(F.col("nome"))),
        lambda f: f.withColumn("nome", F.when(F.col("outra") == 19, F.lit("../fora.txt")).otherwise(F.col("nome"))),
        lambda f: f.withColumn("nome", F.when(F.col("outra") == 19, F.lit(None)).otherwise(F.col("nome"))),
    ],
    ids=["task fails", "name twice", "path", "no name"],
)
def test_a_failed_job_leaves_the_folder_as_it_was(spark, tmp_path, spoilt, overwrite):
    folder = str(tmp_path / "out")
    publish.publish(numbered(spark, 3, "'antes'"), folder)
    with pytest.raises(PySparkException):
        publish.publish(spoilt(numbered(spark, 20)), folder, overwrite)
    assert held(folder) == {f"d{i}.txt": "antes" for i in range(3)}
    assert os.listdir(tmp_path) == ["out"]


def test_result_files_and_the_submission_made_of_them(spark, tmp_path):
    docs = spark.createDataFrame([("a",), ("b",)], "documento_id string")
    found = spark.createDataFrame(
        [("a", 3, 7, "x\ny", "lei", "real", 12, 0.5), ("a", 9, 11, "ção", "lei", "real", 0, None), ("a", 20, 22, "zz", "lei", "incompleta", None, 0.25)],
        "documento_id string, inicio int, fim int, trecho string, tipo string, classificacao string, id_canonico long, confianca double",
    )
    done = results.contract(docs, found)
    results.write_files(done, str(tmp_path / "json"))
    files = held(tmp_path / "json")
    assert sorted(files) == ["a.json", "b.json"] and json.loads(files["b.json"]) == {"documento_id": "b", "citacoes": []}
    assert files["a.json"] == json.dumps(json.loads(files["a.json"]), ensure_ascii=False, indent=2) and "ção" in files["a.json"]
    want = [("a", "3,7,real,12,0.5000|9,11,real,-,-|20,22,incompleta,-,0.2500"), ("b", "-")]
    assert [tuple(r) for r in results.submission_of_files(spark, str(tmp_path / "json")).collect()] == want
    assert tuple(results.totals(done).first()) == (2, 3)
    assert tuple(results.totals(done.limit(0)).first()) == (0, 0)
    documents.write_texts(spark.createDataFrame([("a", "um\r\ndois")], "documento_id string, texto string"), str(tmp_path / "txt"))
    assert held(tmp_path / "txt") == {"a.txt": "um\r\ndois"}
