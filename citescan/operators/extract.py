"""Citations in documents: the body, the spans of each pattern, and which of them stand."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescan.operators import grammar as G
from citescan.operators.starts import starts
from citescan.operators.sweep import standing

THREE_BREAKS = r"\r?\n[ \t]*\r?\n[ \t]*\r?\n"
TWO_BREAKS = r"\r?\n[ \t]*\r?\n"
#: characters at the start of a text in which a single blank line ends the header
HEADER = 1500
SPAN = "struct<inicio:int,fim:int,trecho:string,tipo:string,padrao:string>"


def _first_end(text: Column, pattern: str) -> Column:
    """Where the first match ends."""
    return F.length(F.element_at(F.split(text, pattern, 2), 1)) + F.length(F.regexp_extract(text, pattern, 0))


def body_start(text: Column) -> Column:
    """After the first triple line break, else after the first blank line of the header, else 0."""
    head = F.substring(text, 1, HEADER)
    return F.when(text.rlike(THREE_BREAKS), _first_end(text, THREE_BREAKS)).when(head.rlike(TWO_BREAKS), _first_end(head, TWO_BREAKS)).otherwise(0)


def native_spans(text: Column, pattern: str) -> Column:
    """Start and end of all matches of a pattern without empty matches, inside Spark's own expressions."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        span = F.struct(start.alias("inicio"), (start + s["hit"]).alias("fim"))
        return F.struct((start + s["hit"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<inicio:int,fim:int>>)").alias("spans"))
    return F.aggregate(steps, none, step)["spans"]


#: characters of texts that are searched at once
SLICE = 1 << 20


def _sliced(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``SLICE`` characters."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > SLICE:
            yield first, i
            first, held = i, 0
        held += size
    yield first, len(sizes)


def candidates(docs: DataFrame, generic: bool = False) -> DataFrame:
    """documento_id, body, candidatos: all matches of all patterns in the body, offsets in code points of the text.

    One pass of Arrow batches over all patterns: the grammar is large, and Python's
    ``re`` keeps it compiled for the life of a task. Patterns are tried only where a
    filter over the batch says that they can begin (``starts``).
    """
    patterns = G.selected(generic)
    span = pa.struct([("inicio", pa.int32()), ("size", pa.int32()), ("ordem", pa.int32()), ("trecho", pa.string()), ("tipo", pa.string()), ("padrao", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = starts(*(rule for _, _, rule in patterns))
        names, kinds = (pa.array([p[i] for p in patterns]) for i in (0, 1))
        for batch in batches:
            at = [s or 0 for s in batch.column(2).to_pylist()]
            bodies = [(text or "")[s:] for text, s in zip(batch.column(1).to_pylist(), at, strict=True)]
            for lo, hi in _sliced([len(b) for b in bodies]):
                found = list(search.matches(bodies[lo:hi]))
                each = [(m.start() + s, m.start() - m.end(), r, m[0]) for s, ms in zip(at[lo:hi], found, strict=True) for r, m in ms]
                first, size, order, text = map(list, zip(*each, strict=True)) if each else ([], [], [], [])
                order = pa.array(order, pa.int32())
                columns = [pa.array(first, pa.int32()), pa.array(size, pa.int32()), order, pa.array(text, pa.string()), kinds.take(order), names.take(order)]
                offsets = pa.array([0, *itertools.accumulate(map(len, found))], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(span)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["documento_id", "candidatos"])

    rows = docs.select("documento_id", "texto", body_start(F.coalesce("texto", F.lit(""))).alias("start"))
    kind = docs.schema["documento_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"documento_id {kind}, candidatos array<struct<inicio:int,size:int,ordem:int,trecho:string,tipo:string,padrao:string>>")


def without_overlaps(spans: Column) -> Column:
    """Of spans (inicio, size negative, ordem, ...): from the earliest start, the longest there, then the first pattern; each stands unless it overlaps one that does."""

    def stood(ordered: Column) -> Column:
        kept = lambda s: F.struct(s["inicio"].alias("inicio"), (s["inicio"] - s["size"]).alias("fim"), s["trecho"].alias("trecho"), s["tipo"].alias("tipo"), s["padrao"].alias("padrao"))
        return F.transform(standing(ordered), lambda i: kept(F.get(ordered, i)))

    return stood(F.array_sort(spans)).cast(f"array<{SPAN}>")


def detect(docs: DataFrame, generic: bool = False) -> DataFrame:
    """documento_id, citacoes: the citations of each document of docs (documento_id, texto), in text order.

    A null text has none; documents without citations stay, with an empty array.
    """
    return candidates(docs, generic).select("documento_id", without_overlaps(F.col("candidatos")).alias("citacoes"))


def exploded(detected: DataFrame) -> DataFrame:
    """A row for each citation: documento_id, n (from 1), inicio, fim, trecho, tipo, padrao."""
    return detected.select("documento_id", F.posexplode("citacoes").alias("n", "c")).select("documento_id", (F.col("n") + 1).alias("n"), "c.*")


def level_of(documento_id: Column, any_case: bool = True) -> Column:
    """1 or 2 as the id says, else null."""
    name = F.lower(documento_id) if any_case else documento_id
    return F.when(F.contains(name, F.lit("_n1_")), 1).when(F.contains(name, F.lit("_n2_")), 2)
