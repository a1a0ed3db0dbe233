"""Writers: results as JSON objects and as one compact line for each document."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citescan.sources import documents, publish


def contract(documents: DataFrame, decisions: DataFrame) -> DataFrame:
    """documento_id, citacoes: every document, its citations numbered c1, c2, ... in text order.

    ``decisions`` has documento_id, inicio, fim, trecho, tipo, classificacao, id_canonico, confianca.
    """
    fields = F.struct("inicio", "fim", "trecho", "tipo", "classificacao", "id_canonico", "confianca")
    lists = decisions.groupBy("documento_id").agg(F.array_sort(F.collect_list(fields)).alias("cs"))
    numbered = F.transform(
        "cs",
        lambda c, i: F.struct(
            F.concat(F.lit("c"), (i + 1).cast("string")).alias("citacao_id"),
            c["inicio"].alias("inicio"), c["fim"].alias("fim"), c["trecho"].alias("trecho"), c["tipo"].alias("tipo"), c["classificacao"].alias("classificacao"),
            F.when(c["id_canonico"].isNotNull(), F.struct(c["id_canonico"].alias("id_canonico"))).alias("resolucao"),
            F.round(c["confianca"], 4).alias("confianca"),
        ),
    )
    rows = documents.select("documento_id").distinct().join(lists, "documento_id", "left").withColumn("citacoes", numbered)
    return rows.select("documento_id", F.coalesce("citacoes", F.array().cast(rows.schema["citacoes"].dataType)).alias("citacoes"))


def as_json(citacoes: Column) -> Column:
    """The object of a document as one line, null fields included."""
    return F.to_json(F.struct("documento_id", citacoes.alias("citacoes")), {"ignoreNullFields": "false"})


def encoded(citacoes: Column) -> Column:
    """start,end,class,id or -,confidence of each citation, joined by |; - for none. Without a confidence: -."""
    confident = lambda c: F.when(c["confianca"].isNull(), F.lit("-")).otherwise(F.format_string("%.4f", F.coalesce(c["confianca"], F.lit(0.0))))
    line = lambda c: F.concat_ws(",", c["inicio"], c["fim"], c["classificacao"], F.coalesce(F.nullif(c["resolucao"]["id_canonico"], F.lit(0)).cast("string"), F.lit("-")), confident(c))
    return F.coalesce(F.nullif(F.array_join(F.transform(citacoes, line), "|"), F.lit("")), F.lit("-"))


def submission(results: DataFrame) -> DataFrame:
    """documento_id, citacoes (encoded), sorted by id."""
    return results.select("documento_id", encoded(F.col("citacoes")).alias("citacoes")).orderBy("documento_id")


def write_submission(results: DataFrame, folder: str) -> None:
    """CSV part files with a header, in id order over the files; the committer publishes them when all are written."""
    submission(results).write.csv(folder, header=True)


def indented(object_: str) -> str:
    """A JSON object over several lines, letters as they are."""
    return json.dumps(json.loads(object_), ensure_ascii=False, indent=2)


def write_files(results: DataFrame, folder: str, overwrite: bool = False) -> None:
    """One indented JSON file for each document, named by its id, published when all are written (``publish.publish``)."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([indented(t) for t in batch.column(1).to_pylist()], pa.string())], names=["nome", "conteudo"])

    named = results.select(F.concat("documento_id", F.lit(".json")).alias("nome"), as_json(F.col("citacoes")).alias("conteudo"))
    publish.publish(named.mapInArrow(lines, publish.FILE), folder, overwrite)


def submission_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a submission from a folder of result files."""
    return submission(documents.read_results(spark, folder))


def totals(results: DataFrame) -> DataFrame:
    """documentos, citacoes: one row."""
    return results.agg(F.count("*").alias("documentos"), F.coalesce(F.sum(F.size("citacoes")), F.lit(0)).alias("citacoes"))
