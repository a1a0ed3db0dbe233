"""Span matching, containment, selection and the start filter against plain versions."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citescan.operators import evaluate, extract, sweep
from citescan.operators import grammar as G
from citescan.operators.starts import Starts, starts


def plain_pairs(pred, gold, least, larger_first):
    pairs = []
    for i, a in enumerate(pred):
        for j, b in enumerate(gold):
            both = min(a[1], b[1]) - max(a[0], b[0])
            if both > 0 and (x := both / (a[1] - a[0] + b[1] - b[0] - both)) >= least:
                pairs.append((x, i, j))
    pairs.sort(key=lambda x: (-x[0], -x[1], -x[2]) if larger_first else (-x[0], x[2], x[1]))
    used_p, used_g, out = set(), set(), []
    for x, i, j in pairs:
        if i not in used_p and j not in used_g:
            used_p.add(i)
            used_g.add(j)
            out.append((x, i + 1, j + 1))
    return out


def some_spans(rng, most, room=60):
    return sorted((s, s + rng.choice([0, 1, 2, 3, 5, 8, 20, 60])) for s in (rng.randrange(room) for _ in range(rng.randrange(most))))


def test_pairs_against_all_pairs():
    rng = random.Random(1)
    for _ in range(600):
        pred, gold = some_spans(rng, 12), some_spans(rng, 12)
        a, b = (np.array(x, dtype=np.int64).reshape(-1, 2) for x in (pred, gold))
        for least in (0.0, 0.3, 0.5, 1.0):
            p, g, iou = sweep.overlapping(a, b, least)
            for late in (True, False):
                some = sweep.one_to_one(p, g, iou, len(pred), len(gold), late)
                assert [(iou[i], p[i] + 1, g[i] + 1) for i in some] == plain_pairs(pred, gold, least, late)
        inside = [x[1] > x[0] and any(min(x[1], y[1]) - max(x[0], y[0]) >= 0.9 * (x[1] - x[0]) for y in gold) for x in pred]
        assert sweep.contained(a, b, 0.9).tolist() == inside


def test_pairs_in_parts(monkeypatch):
    rng = random.Random(2)
    a, b = (np.array([s for _ in range(8) for s in some_spans(rng, 40)], dtype=np.int64).reshape(-1, 2) for _ in range(2))
    whole = sweep.overlapping(a, b, 0.3)
    monkeypatch.setattr(sweep, "PAIRS", 7)
    assert all(np.array_equal(x, y) for x, y in zip(whole, sweep.overlapping(a, b, 0.3), strict=True))


def test_rows_of_arrays(spark):
    rng, rows = random.Random(3), []
    for i in range(40):
        rows.append((i, some_spans(rng, 9), some_spans(rng, 9)))
    spans = "array<struct<inicio:int,fim:int>>"
    df = spark.createDataFrame([*rows, (40, [], []), (41, None, [])], f"documento_id int, pred {spans}, gold {spans}").repartition(3)
    for r in df.withColumn("m", evaluate.matched(F.col("pred"), F.col("gold"), 0.3)).collect():
        assert [tuple(x) for x in r.m] == plain_pairs(r.pred or [], r.gold or [], 0.3, True)


def test_a_batch_of_documents_is_one_sweep(monkeypatch):
    rng, calls, overlapping = random.Random(5), [], sweep.overlapping
    monkeypatch.setattr(sweep, "overlapping", lambda *a: calls.append(1) or overlapping(*a))
    for shift in (0, -50, 2**31 - 200):
        docs = [([(a + shift, b + shift) for a, b in some_spans(rng, 6)], [(a + shift, b + shift) for a, b in some_spans(rng, 6)]) for _ in range(300)]
        ends = [pa.array([[x[i] for x in d[side]] for d in docs], pa.list_(pa.int32())) for side in (0, 1) for i in (0, 1)]
        laid = sweep._Laid(*ends)
        p, g, iou = laid.pairs(0.5, True)
        got = laid.lists(laid.of[0][p], iou=pa.array(iou), p=pa.array(laid.place(0, p)), g=pa.array(laid.place(1, g))).to_pylist()
        assert [[tuple(x.values()) for x in d] for d in got] == [plain_pairs(a, b, 0.5, True) for a, b in docs]
    assert len(calls) == 3


def test_a_document_with_many_spans(spark):
    n = 20_000
    def rows(d, late):
        return spark.range(n).selectExpr("'doc' as documento_id", f"cast(id * 37 + (id * 7919) % 5 + {d} as int) as inicio").selectExpr("*", "cast(inicio + 20 + (inicio % 61) as int) as fim").selectExpr("*", "concat('c', inicio) as trecho")

    pred, gold = rows(0, True), rows(3, False)
    began = time.time()
    total = evaluate.extraction(pred, gold).filter("documento_id is null").first()
    assert time.time() - began < 60 and total.tp > n // 4 and total.tp + total.fp == n == total.tp + total.fn
    spans = extract.without_overlaps(F.collect_list(F.struct("inicio", (F.col("inicio") - F.col("fim")).alias("size"), F.lit(0).alias("ordem"), "trecho", F.lit("t").alias("tipo"), F.lit("p").alias("padrao"))))
    stood = pred.groupBy("documento_id").agg(spans.alias("s")).first().s
    assert all(a.fim <= b.inicio for a, b in zip(stood, stood[1:], strict=False)) and len(stood) > n // 3


PIECES = [
    "REsp", "Recurso Especial", "recurs0 e5pecia1", "AgInt no ", "nº ", "1.234.567", "123-45.2019.5.02.0031", "/SP", " ", "\n", "Súmula", "SÚMULA vinculante", "sumuIa", "art.", "artigo 5º", ", II, ", "da Constituição Federal",
    "do CPC", "Tema 12", "OJ 3", "julgado do STJ em 2019", " pela relatoria de Ana Maria", "pacífica jurisprudência do STF", "legislação aplicável à espécie", "x", "HC", "Processo n. ", "ſúmula 7", "İı", "\U0001f600",
    "enunciado 331 da súmula do TST", "\U0001f600Tema 3", "verbete", "Rcl", "0", "rn", "_", "Min. ", "-", "(RJ)",
]


@pytest.mark.parametrize("rules", [tuple(r for _, _, r in G.PATTERNS), ("processo", "numero_cnj", "loose_cnj")])
def test_starts_find_what_a_search_finds(rules, monkeypatch):
    rng = random.Random(4)
    texts = ["", *("".join(rng.choice(PIECES) + rng.choice(["", " ", " ", "\n", ", "]) for _ in range(rng.randrange(25))) for _ in range(400)), "REsp 1", "Tema 3"]
    plain = [[(i, m.span()) for i, r in enumerate(rules) for m in G.compiled(r).finditer(t)] for t in texts]
    assert sum(map(len, plain)) > 300 or len(rules) == 3
    assert [[(i, m.span()) for i, m in found] for found in starts(*rules).matches(texts)] == plain
    monkeypatch.setattr("citescan.operators.starts.CHUNK", 11)
    assert [[(i, m.span()) for i, m in found] for found in Starts(rules).matches(texts)] == plain


def test_table_function_finds_what_detect_finds(spark):
    from citescan.operators import table_function

    rng = random.Random(6)
    texts = [None, "", "CAB\n\n\nREsp 1.234.567/SP", *("".join(rng.choice(PIECES) + rng.choice([" ", "\n", ", "]) for _ in range(25)) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "documento_id int, texto string").repartition(3)
    docs.createOrReplaceTempView("some_texts")
    table_function.register(spark)
    for generic in (False, True):
        found = spark.sql(f"SELECT documento_id, c.* FROM some_texts, LATERAL citations(texto, {str(generic).lower()}) c")
        expected = extract.exploded(extract.detect(docs, generic)).drop("n")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect())) != []


def test_table_function_searches_texts_together(monkeypatch):
    from citescan.operators import table_function

    calls, matches = [], Starts.matches
    monkeypatch.setattr(Starts, "matches", lambda self, texts: calls.append(len(texts)) or matches(self, texts))
    texts = pa.array(["CAB\n\n\nREsp 1.234.567/SP", None, "", "pacífica jurisprudência do STF e o HC 1234"] * 100)
    got = table_function._citations(texts, pa.array([False, False, None, True] * 100)).to_pylist()
    assert [len(x) for x in got] == [1, 0, 0, 2] * 100 and got[0][0]["trecho"] == "REsp 1.234.567/SP" and got[0][0]["inicio"] == 6
    assert sorted(calls) == [100, 300]
