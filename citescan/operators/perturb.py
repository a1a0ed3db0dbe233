"""Noise on citations: transformations chosen by hashes of a key, so that every run makes the same ones."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescan.functions import lexicon as L
from citescan.functions.norm import let
from citescan.operators.evaluate import IOU, iou
from citescan.operators.extract import detect, native_spans
from citescan.session import keep

# Other ways to write the same.
ABBREVIATIONS = [
    (r"\bREsp\b", ["R.Esp.", "Rec. Esp.", "Recurso Especial", "RESP"]),
    (r"\bRecurso Especial\b", ["REsp", "Rec. Esp.", "R. Esp."]),
    (r"\bAREsp\b", ["Agravo em Recurso Especial", "ARESP", "A.REsp"]),
    (r"\bAgInt\b", ["Ag. Int.", "AGINT", "Agravo Interno"]),
    (r"\bAgRg\b", ["Ag. Rg.", "Agravo Regimental"]),
    (r"\bEDcl\b", ["Embargos de Declaração", "ED"]),
    (r"\bRHC\b", ["R.H.C.", "Recurso em Habeas Corpus"]),
    (r"\bHC\b", ["H.C.", "Habeas Corpus"]),
    (r"\bRMS\b", ["Recurso em Mandado de Segurança"]),
    (r"\bRcl\b", ["Reclamação", "Recl.", "RCL"]),
    (r"\bReclamação\b", ["Rcl", "Recl."]),
    (r"\bSúmula\b", ["Súm.", "SÚMULA", "Enunciado"]),
    (r"\bart\.", ["artigo", "art", "Art."]),
    (r"\bartigo\b", ["art."]),
]
MARKERS = ["nº", "n.", "n°", "No", "Nº", "número"]
MARKER = r"\b(?:n[º°]|N[º°o]|n\.)(?=\s)"
THOUSANDS = r"\b\d{1,3}(?:\.\d{3})+\b"
UF_END = r"(?:\s*[/\-–]\s*|\s*\(\s*)(?:" + "|".join(L.UFS) + r")\)?$"
SWAPS = {"0": "O", "1": "l", "5": "S", "m": "rn"}
#: what is misread where nothing of the set before is there: the other digits that have lookalikes, then letters
RARER_SWAPS = [{"2": "Z", "6": "G", "7": "T", "8": "B", "9": "g"}, {"s": "5", "l": "1"}]

Noise = Callable[[Column, Column], Column]


def pick(key: Column, salt: str, n: Column | int) -> Column:
    """A number from 0 to n - 1."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.xxhash64(F.lit(salt), key), F.greatest(n, F.lit(1)).cast("long")).cast("int")


def replace_one(text: Column, pattern: str, key: Column, new: Callable[[Column], Column]) -> Column:
    """``text`` with one match of the pattern, chosen by the key, replaced; as it is without a match."""

    def change(s: Column) -> Column:
        old = F.substring(text, s["inicio"] + 1, s["fim"] - s["inicio"])
        return F.concat(F.substring(text, F.lit(1), s["inicio"]), let(old, new), F.substring(text, s["fim"] + 1, F.length(text)))

    chosen = let(native_spans(text, "(?U)" + pattern), lambda spans: F.get(spans, pick(key, pattern, F.size(spans))))
    return F.coalesce(let(chosen, change), text)


def _one_of(values: list[str], key: Column, salt: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), pick(key, salt, len(values)))


def _any_form(forms: list[str], key: Column) -> Callable[[Column], Column]:
    return lambda _: _one_of(forms, key, "form")


def abbreviation(text: Column, key: Column) -> Column:
    fits = F.array_compact(F.array(*[F.when(text.rlike("(?U)" + p), F.lit(i)) for i, (p, _) in enumerate(ABBREVIATIONS)]))

    def by(rule: Column) -> Column:
        out = text
        for i, (pattern, forms) in enumerate(ABBREVIATIONS):
            out = F.when(rule == i, replace_one(text, pattern, key, _any_form(forms, key))).otherwise(out)
        return out

    return let(let(fits, lambda some: F.get(some, pick(key, "rule", F.size(some)))), by)


def number_marker(text: Column, key: Column) -> Column:
    return replace_one(text, MARKER, key, lambda _: _one_of(MARKERS, key, "marker"))


def number_format(text: Column, key: Column) -> Column:
    """2.305.118 as 2305118, 2 305 118 or 2.305. 118."""

    def new(old: Column) -> Column:
        groups = F.split(old, r"\.")
        cut = 1 + pick(key, "cut", F.size(groups) - 1)
        torn = F.concat(F.array_join(F.slice(groups, F.lit(1), cut), "."), F.lit(". "), F.array_join(F.slice(groups, cut + 1, F.size(groups)), "."))
        style = pick(key, "style", 3)
        return F.when(style == 0, F.array_join(groups, "")).when(style == 1, F.array_join(groups, " ")).otherwise(torn)

    return replace_one(text, THOUSANDS, key, new)


def uf_separator(text: Column, key: Column) -> Column:
    def new(old: Column) -> Column:
        uf = F.regexp_extract(old, "[A-Z]{2}", 0)
        forms = F.array(*[F.concat(F.lit(a), uf, F.lit(b)) for a, b in (("/", ""), (" - ", ""), (" (", ")"), ("-", ""), ("/ ", ""))])
        return F.get(forms, pick(key, "uf", 5))

    return replace_one(text, UF_END, key, new)


def ocr(text: Column, key: Column) -> Column:
    """One character as a scanner might have read it; the rarer confusions only where a text has none of the others."""

    def by(swaps: dict[str, str], else_: Column) -> Column:
        def new(old: Column) -> Column:
            return functools.reduce(lambda acc, kv: F.when(old == kv[0], F.lit(kv[1])).otherwise(acc), swaps.items(), old)

        some = "[" + "".join(swaps) + "]"
        return F.when(text.rlike(some), replace_one(text, some, key, new)).otherwise(else_)

    return by(SWAPS, by(RARER_SWAPS[0], by(RARER_SWAPS[1], text)))


def line_break(text: Column, key: Column) -> Column:
    return replace_one(text, r" (?=\S)", key, lambda _: F.lit("\n"))


def upper_case(text: Column, key: Column) -> Column:
    return replace_one(text, r"\b[A-Za-zÀ-ÿ]{3,}\b", key, F.upper)


NOISES: dict[str, Noise] = {
    "abbreviation": abbreviation, "number_marker": number_marker, "number_format": number_format, "uf_separator": uf_separator,
    "ocr": ocr, "line_break": line_break, "upper_case": upper_case,
}


def varied(rows: DataFrame, text: str, key: str, name: str, noises: list[str] | None = None, most: int = 3, seed: int = 2026) -> DataFrame:
    """``rows`` with a column of noisy texts: one to ``most`` different noises each, chosen by hash, one after the other."""
    names = noises or list(NOISES)
    most = min(most, len(names))
    order = F.transform(F.array_sort(F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(i), F.col(key)).alias("h"), F.lit(i).alias("i")) for i in range(len(names))])), lambda x: x["i"])
    out = rows.withColumns({"_order": order, "_many": 1 + pick(F.col(key), f"many{seed}", most), name: F.col(text)})
    for step in range(most):
        now = F.col(name)
        for i, n in enumerate(names):
            own = F.concat_ws("|", F.col(key).cast("string"), F.lit(step))
            now = F.when((F.col("_many") > step) & (F.get("_order", step) == i), NOISES[n](F.col(name), own)).otherwise(now)
        out = keep(out.withColumn(name, now), "noise")  # a plan of its own for each step: the expressions are long
    return out.drop("_order", "_many")


def noisy_documents(docs: DataFrame, gold: DataFrame, variants: int = 5, seed: int = 2026) -> DataFrame:
    """documento_id, texto, inicio, fim: each document once for each changed variant of each gold span that is where it should be."""
    spans = gold.select("documento_id", "inicio", "fim", "trecho").distinct().join(docs, "documento_id")
    spans = spans.filter(F.substring("texto", F.col("inicio") + 1, F.col("fim") - F.col("inicio")) == F.col("trecho"))
    each = spans.select("*", F.explode(F.sequence(F.lit(1), F.lit(variants))).alias("v"))
    each = each.withColumn("key", F.concat_ws("|", "documento_id", "inicio", "fim", "v"))
    noisy = varied(each, "trecho", "key", "novo", seed=seed).filter("novo <> trecho")
    text = F.concat(F.substring("texto", F.lit(1), F.col("inicio")), F.col("novo"), F.substring("texto", F.col("fim") + 1, F.length("texto")))
    return noisy.select("key", text.alias("texto"), "inicio", (F.col("inicio") + F.length("novo")).alias("fim"))


def robustness(docs: DataFrame, gold: DataFrame, variants: int = 5, seed: int = 2026) -> DataFrame:
    """variants, detected, recall: how many noisy citations are still found in their documents."""
    noisy = noisy_documents(docs, gold, variants, seed)
    found = detect(noisy.select(F.struct("key", "inicio", "fim").alias("documento_id"), "texto"))
    hit = F.exists("citacoes", lambda c: iou(c, F.col("documento_id")) >= IOU)
    sums = found.agg(F.count("*").alias("variants"), F.count_if(hit).alias("detected"))
    return sums.withColumn("recall", F.coalesce(F.try_divide("detected", "variants"), F.lit(0.0)))


def recall_by(rows: DataFrame, group: str, key: str, snippet: str, before: str, after: str) -> DataFrame:
    """group, variants, found: whether at least 99 of 100 snippets, each put between two texts, are found where they are."""
    texts = rows.select(F.struct(F.col(group).alias("group"), F.col(key).alias("key"), F.length(snippet).alias("size")).alias("documento_id"), F.concat(F.lit(before), snippet, F.lit(after)).alias("texto"))
    there = F.struct(F.lit(len(before)).alias("inicio"), (F.lit(len(before)) + F.col("documento_id.size")).alias("fim"))
    hit = F.exists("citacoes", lambda c: iou(c, there) >= IOU)
    sums = detect(texts).groupBy(F.col("documento_id.group").alias(group)).agg(F.count("*").alias("variants"), F.count_if(hit).alias("hits"))
    return sums.select(group, "variants", (F.col("hits") >= 0.99 * F.col("variants")).alias("found"))
