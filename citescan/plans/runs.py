"""A whole run in one call: read, find and decide, evaluate what there is to evaluate, write what there is to write."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citescan.operators import evaluate
from citescan.operators.extract import level_of
from citescan.plans import pipeline
from citescan.session import keep
from citescan.sources import documents, results


@dataclass(frozen=True)
class Profile:
    """The files of a run; without a base citations are found only, without annotations nothing is evaluated."""

    texts: str
    annotations: str | None = None
    base: str | None = None

    @classmethod
    def of(cls, folder: str, base: str) -> Profile:
        """A snapshot with its texts and annotations beneath one folder and its base where told."""
        return cls(os.path.join(folder, "txt"), os.path.join(folder, "goldenset.csv"), base)


@dataclass(frozen=True)
class Outcome:
    """What a run has made; None stands for a step that had nothing to work on."""

    citations: DataFrame
    levels: DataFrame
    results: DataFrame | None = None
    totals: DataFrame | None = None
    #: extraction, classification, official_levels, official, calibration by name
    reports: dict[str, DataFrame] = field(default_factory=dict)
    written: str | None = None


def run(spark: SparkSession, profile: Profile, output: str | None = None, exact: bool = False, generic: bool = False, calibrated: bool = False) -> Outcome:
    """Citations of all texts of a profile, and what follows from them.

    Extraction is evaluated wherever there are annotations, on the documents that were
    read; classes, official score and calibration only with decisions, on documents of
    either side. Result files (``json``) and the submission (``csv``) go beneath ``output``
    only with decisions, an existing ``output`` is an error.
    """
    if output is not None and os.path.lexists(output):
        raise FileExistsError(f"output exists: {output}")
    docs = documents.read_texts(spark, profile.texts)
    ids = docs.select("documento_id")
    base = None if profile.base is None else documents.read_base(spark, profile.base)
    confidence = pipeline.calibrated() if calibrated and base is not None else None
    found = keep(pipeline.run(docs, base, generic, confidence), "citations")
    levels = ids.groupBy(level_of(F.col("documento_id")).alias("nivel")).agg(F.count("*").alias("documentos"))
    reports = {}
    if profile.annotations is not None:
        gold = keep(documents.read_annotations(spark, profile.annotations), "annotations")
        reports["extraction"] = evaluate.extraction(found, documents.gold_spans(gold).join(ids, "documento_id", "left_semi"), exact)
        if base is not None:
            for report in (evaluate.classification, evaluate.official_levels, evaluate.official, evaluate.calibration):
                reports[report.__name__] = report(found, gold)
    if base is None:
        return Outcome(found, levels, reports=reports)
    done = keep(results.contract(docs, found), "results")
    if output is not None:
        results.write_files(done, os.path.join(output, "json"))
        results.write_submission(done, os.path.join(output, "csv"))
    return Outcome(found, levels, done, results.totals(done), reports, output)
