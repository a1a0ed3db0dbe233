"""The whole plan: documents and a canonical base in, decided citations out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescan.operators import canonical, resolve
from citescan.operators.extract import detect, exploded
from citescan.session import keep


def decide(citations: DataFrame, records: DataFrame, confidence: Column | None = None) -> DataFrame:
    """citations with classificacao, id_canonico, regra, motivo, confianca (1.0 unless given)."""
    cases = keep(canonical.cases(records), "cases")
    decided = resolve.resolve(citations, cases, canonical.sumulas(records), canonical.articles(records))
    return decided.withColumn("confianca", resolve.fixed_confidence() if confidence is None else confidence)


def run(documents: DataFrame, records: DataFrame | None, generic: bool = False, confidence: Column | None = None) -> DataFrame:
    """A row for each citation of documents (documento_id, texto); without a base the citations are only found."""
    found = exploded(keep(detect(documents, generic), "detected"))
    return found if records is None else decide(found, records, confidence)


def calibrated() -> Column:
    return resolve.confidence(F.col("regra"))
