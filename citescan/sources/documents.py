"""Readers: a folder of texts, annotations, a canonical base in SQLite, result files."""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from citescan.operators.canonical import RECORD
from citescan.sources import publish


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """documento_id, texto of the ``*.txt`` files of a folder, unchanged, not of its subfolders.

    The id is the file's name without its ending. Bytes that are no UTF-8, and empty
    files, are errors.
    """
    return named_texts(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "false").load(folder))


def named_texts(files: DataFrame) -> DataFrame:
    """documento_id, texto of files (path, content)."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "")
    text = F.when(F.length("content") > 0, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("empty document: "), "path")))
    return files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("documento_id"), text.alias("texto"))


def write_texts(docs: DataFrame, folder: str, overwrite: bool = False) -> None:
    """A file for each row of documento_id, texto, published when all are written (``publish.publish``)."""
    publish.publish(docs.select(F.concat("documento_id", F.lit(".txt")).alias("nome"), F.col("texto").alias("conteudo")), folder, overwrite)


GOLD = "nivel int, documento_id string, citacao_id string, inicio int, fim int, trecho string, tipo string, classificacao string, id_canonico string"


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """All annotations of a CSV file, with or without a byte order mark; ``\\n`` in a snippet is a line break.

    ``ids_aceitos`` are the accepted ids, which the file sets apart by white space.
    """
    rows = spark.read.csv(path, header=True, schema=GOLD, multiLine=True, escape='"')
    ids = F.transform(F.filter(F.split(F.coalesce("id_canonico", F.lit("")), r"\s+"), lambda x: x != ""), lambda x: x.cast("long"))
    return rows.withColumn("trecho", F.replace("trecho", F.lit("\\n"), F.lit("\n"))).withColumn("ids_aceitos", ids).drop("id_canonico", "citacao_id")


def gold_spans(annotations: DataFrame) -> DataFrame:
    """The distinct spans of annotations."""
    return annotations.select("documento_id", "inicio", "fim", "trecho").distinct()


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _SqliteReader(DataSourceReader):
    """The rows of one table, in ranges of rowid."""

    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"').fetchone()
        width = max(1, -(-(high - low + 1) // self.parts))
        return [_Rows(a, min(a + width - 1, high)) for a in range(low, high + 1, width)]

    def read(self, partition: _Rows):
        names = ", ".join(f'"{c}"' for c in self.columns)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid', (partition.first, partition.last))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").schema(...).option("path", ...).option("table", ...)``; the path is one that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options["path"], self.options["table"], [f.name for f in schema.fields], int(self.options.get("parts", "8")))


def write_base(records: DataFrame, path: str) -> None:
    """A SQLite file of canonical records, which come to the driver part by part: one file has one writer."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE documentos ({', '.join(names)})")
        db.executemany(f"INSERT INTO documentos VALUES ({', '.join('?' * len(names))})", map(tuple, records.select(*names).toLocalIterator()))
    db.close()


def read_base(spark: SparkSession, path: str) -> DataFrame:
    """The canonical records of a SQLite file."""
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no canonical base: {path}")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").schema(RECORD).option("path", path).option("table", "documentos").load()


RESULT = (
    "documento_id string, citacoes array<struct<citacao_id:string,inicio:int,fim:int,trecho:string,tipo:string,"
    "classificacao:string,resolucao:struct<id_canonico:long>,confianca:double>>"
)


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result files, one JSON object each; without an id the file's name is the id. No file at all is an error."""
    rows = spark.read.schema(RESULT).option("pathGlobFilter", "*.json").json(folder, multiLine=True)
    stem = F.regexp_replace("_metadata.file_name", r"\.json$", "")
    found = rows.select(F.coalesce("documento_id", stem).alias("documento_id"), "citacoes")
    if found.isEmpty():
        raise FileNotFoundError(f"no result files: {folder}")
    return found
