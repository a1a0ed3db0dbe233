"""Detection and decision on streams: both keep no state, so the batch operators run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citescan.operators.extract import detect
from citescan.sources.documents import named_texts


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """documento_id, texto of the text files that arrive in a folder, by the rules of the batch reader."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return named_texts(rows.option("pathGlobFilter", "*.txt").load(folder))


def write_detected(docs: DataFrame, folder: str, checkpoint: str, generic: bool = False):
    """A started query that appends the citations of arriving documents as Parquet, each document once."""
    found = detect(docs, generic)
    return found.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
