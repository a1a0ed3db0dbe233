"""Citations as a table function of SQL: ``FROM documents, LATERAL citations(texto)``."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from citescan.operators import extract
from citescan.operators import grammar as G
from citescan.operators.starts import starts

COLUMNS = "inicio int, fim int, trecho string, tipo string, padrao string"
LIST = f"array<struct<{COLUMNS.replace(' ', ':').replace(',:', ',')}>>"


def body_of(text: str) -> int:
    """Where the body begins, as ``extract.body_start`` says."""
    m = re.search(extract.THREE_BREAKS, text) or re.search(extract.TWO_BREAKS, text[: extract.HEADER])
    return m.end() if m else 0


def citations_of(texts: list[str | None], generic: bool) -> Iterator[list[tuple[int, int, str, str, str]]]:
    """Of each text the citations that stand, in text order."""
    patterns = G.selected(generic)
    search, at = starts(*(rule for _, _, rule in patterns)), [body_of(t or "") for t in texts]
    bodies = [(t or "")[first:] for t, first in zip(texts, at, strict=True)]
    for lo, hi in extract._sliced([len(b) for b in bodies]):
        for first, found in zip(at[lo:hi], search.matches(bodies[lo:hi]), strict=True):
            last, stood = 0, []
            for start, size, order, said in sorted((m.start() + first, m.start() - m.end(), r, m[0]) for r, m in found):
                if start >= last:
                    last = start - size
                    stood.append((start, last, said, patterns[order][1], patterns[order][0]))
            yield stood


def _citations(texto: pa.Array, generic: pa.Array) -> pa.Array:
    texts, wanted = texto.to_pylist(), [bool(g) for g in generic.to_pylist()]
    found: list[list[tuple]] = [[] for _ in texts]
    for kind in set(wanted):
        rows = [i for i, g in enumerate(wanted) if g == kind]
        for i, stood in zip(rows, citations_of([texts[i] for i in rows], kind), strict=True):
            found[i] = stood
    each = list(zip(*itertools.chain.from_iterable(found), strict=True)) or [()] * 5
    fields = [pa.array(c, pa.int32() if i < 2 else pa.string()) for i, c in enumerate(each)]
    ends = pa.array([0, *itertools.accumulate(map(len, found))], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names=[c.split()[0] for c in COLUMNS.split(", ")]))


def register(spark: SparkSession, name: str = "citations") -> None:
    """Register ``citations(texto[, generic])``: inicio, fim, trecho, tipo, padrao of each citation of a text; none for a null text.

    The texts of a batch are searched together, by a function ``<name>_of`` that
    returns a text's citations as an array.
    """
    spark.udf.register(f"{name}_of", F.arrow_udf(_citations, LIST))
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(texto STRING, generic BOOLEAN DEFAULT false) RETURNS TABLE ({COLUMNS}) "
        f"RETURN SELECT c.inicio, c.fim, c.trecho, c.tipo, c.padrao FROM explode({name}_of(texto, generic)) AS t(c)"
    )
