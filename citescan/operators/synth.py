"""Synthetic citations made from the canonical tables, with what should be decided on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescan.functions import lexicon as L
from citescan.functions import norm as N
from citescan.operators import perturb as P
from citescan.operators.extract import detect, exploded
from citescan.session import keep

# Forms of citations by court and law.
CLASSES = {
    "STJ": ["REsp", "AgInt no REsp", "AREsp", "Recurso Especial", "HC", "RHC"],
    "STF": ["Rcl", "AgR na Rcl", "RE", "ARE", "HC"],
    "TST": ["RR", "AIRR", "Ag-AIRR", "E-RR"],
    "TSE": ["REspe", "AgR-REspe", "RO"],
    "STM": ["APL", "RSE", "Apelação Criminal"],
}
LAW_FORMS = {
    "CPC": ["do CPC", "do Código de Processo Civil", "da Lei 13.105/2015"],
    "CC": ["do Código Civil", "do CC"],
    "CLT": ["da CLT", "da Consolidação das Leis do Trabalho"],
    "CF": ["da CF", "da Constituição Federal", "da CF/88"],
    "CPP": ["do CPP", "do Código de Processo Penal"],
    "CPM": ["do CPM", "do Código Penal Militar"],
    "CDC": ["do CDC", "do Código de Defesa do Consumidor", "da Lei 8.078/90"],
    "CE": ["do Código Eleitoral"],
    "LC64": ["da Lei Complementar nº 64/1990", "da LC 64/90"],
}
DESCRIPTIONS = ["julgado do {t} proferido em {a} pela relatoria de {n}", "precedente do {t} de {a}, da relatoria de {n}", "acórdão do {t} julgado em {a} sob relatoria de {n}"]


def written(numero: Column, key: Column) -> Column:
    """A case number in one of its written forms."""
    seq, tail = F.substring_index(numero, "-", 1), F.substring_index(numero, "-", -1)
    part = lambda a, n: F.substring(tail, a, n)
    dots = F.concat(part(1, 2), F.lit("."), part(3, 4), F.lit("."), part(7, 1), F.lit("."), part(8, 2), F.lit("."), part(10, 4))
    wide = F.lpad(seq, 7, "0")
    unified = F.array(F.concat(seq, F.lit("-"), dots), F.concat(wide, F.lit("-"), dots), F.concat(wide, F.lit("-"), tail))
    dotted = F.replace(F.format_number(numero.try_cast("long"), 0), F.lit(","), F.lit("."))
    short = F.array(dotted, numero.try_cast("long").cast("string"), F.replace(dotted, F.lit("."), F.lit(" ")))
    # too long for a number: as it is
    short = F.transform(short, lambda s: F.coalesce(s, numero))
    return F.get(F.when(F.contains(numero, F.lit("-")), unified).otherwise(short), P.pick(key, "form", 3))


def case_citation(tribunal: Column, numero: Column, uf: Column, key: Column) -> Column:
    """A citation of a case by class, number and state."""
    name = F.lit(None).cast("string")
    for court, forms in CLASSES.items():
        name = F.when(tribunal == court, P._one_of(forms, key, "class")).otherwise(name)
    joint = F.when(tribunal == "TST", F.lit("-")).otherwise(P._one_of([" nº ", " n. ", " "], key, "joint"))
    state = F.when(uf.isNull(), F.lit("")).otherwise(F.get(F.array(F.concat(F.lit("/"), uf), F.concat(F.lit(" - "), uf), F.concat(F.lit(" ("), uf, F.lit(")"))), P.pick(key, "state", 3)))
    return F.concat(name, joint, written(numero, key), state)


def sentence(text: Column, before: str = "Conforme o ", after: str = ", a tese foi acolhida.") -> Column:
    return F.concat(F.lit("CAB\n\n\n" + before), text, F.lit(after))


def sampled(cases: DataFrame, size: int = 300, seed: int = 42) -> DataFrame:
    """A sample of cases of the five courts, the same in every run."""
    known = cases.filter(F.col("tribunal").isin(*CLASSES))
    return known.orderBy(F.xxhash64(F.lit(seed), "tribunal", "numero"), "tribunal", "numero").limit(size)


def real_cases(cases: DataFrame, noisy: bool = False, seed: int = 42) -> DataFrame:
    """grupo, documento_id, texto, classe, ids: citations of cases that exist."""
    key = F.concat_ws("|", F.lit(seed), "tribunal", "numero")
    rows = cases.withColumn("key", key).withColumn("cit", case_citation(F.col("tribunal"), F.col("numero"), F.get("ufs", 0), F.col("key")))
    if noisy:
        rows = P.varied(rows, "cit", "key", "cit2", ["ocr", "line_break", "uf_separator", "upper_case"], 2, seed).withColumn("cit", F.col("cit2"))
    name = "processo real com ruído" if noisy else "processo real"
    return rows.select(F.lit(name).alias("grupo"), F.concat_ws("|", F.lit(name), "key").alias("documento_id"), sentence(F.col("cit")).alias("texto"), F.lit("real").alias("classe"), F.transform("registros", lambda r: r["id"]).alias("ids"))


def mutated(numero: Column, key: Column) -> Column:
    """The number with one of its first four digits changed."""
    bare = F.replace(numero, F.lit("-"), F.lit(""))
    at = P.pick(key, "digit", F.least(F.length(bare), F.lit(4))) + 1
    at = F.when(F.contains(numero, F.lit("-")) & (at > F.length(F.substring_index(numero, "-", 1))), at + 1).otherwise(at)
    digit = F.pmod(F.substring(numero, at, F.lit(1)).cast("int") + 1 + P.pick(key, "step", 8), F.lit(10)).cast("string")
    return F.concat(F.substring(numero, F.lit(1), at - 1), digit, F.substring(numero, at + 1, F.length(numero)))


def invented_cases(cases: DataFrame, base: DataFrame, seed: int = 42) -> DataFrame:
    """Citations of numbers that no case of ``base`` has, one digit from a number that one has.

    Where that digit makes a number that ``base`` has, or one that begins with 0, the
    number is instead made longer than any that ``base`` has; unified numbers, whose length is
    fixed, and those that would be taken for one are left out there.
    """
    key = F.concat_ws("|", F.lit(seed), "tribunal", "numero")
    rows = cases.withColumn("key", key).withColumn("made", mutated(F.col("numero"), F.col("key")))
    taken = base.select(F.col("numero").alias("made"), F.lit(True).alias("taken")).distinct()
    longest = base.agg(F.max(F.when(~F.contains("numero", F.lit("-")), F.length("numero"))).alias("longest"))
    # one row
    rows = rows.join(taken, "made", "left").crossJoin(F.broadcast(longest))
    size = F.greatest(F.coalesce("longest", F.lit(0)), F.length("numero")) + 1
    longer = F.rpad("numero", size, P.pick(F.col("key"), "longer", 10).cast("string"))
    longer = F.when(~F.contains("numero", F.lit("-")) & (size < N.CNJ_TAIL + 1), longer)
    rows = rows.withColumn("numero", F.when(F.col("taken") | F.startswith("made", F.lit("0")), longer).otherwise(F.col("made"))).filter("numero is not null")
    cit = case_citation(F.col("tribunal"), F.col("numero"), F.get("ufs", 0), F.col("key"))
    return rows.select(F.lit("processo inventado").alias("grupo"), F.concat_ws("|", F.lit("inventado"), "key").alias("documento_id"), sentence(cit).alias("texto"), F.lit("inventada").alias("classe"), F.lit(None).cast("array<bigint>").alias("ids"))


def _catalogue(spark, rows: list[tuple[str, str, str]]) -> DataFrame:
    named = [(g, f"{g}|{i}", "CAB\n\n\n" + t, c) for i, (g, t, c) in enumerate(rows)]
    return spark.createDataFrame(named, "grupo string, documento_id string, texto string, classe string").withColumn("ids", F.lit(None).cast("array<bigint>"))


def catalogue(spark) -> DataFrame:
    """Citations of the known precedents and articles in several forms, of articles under a wrong law and of precedents that do not exist."""
    rows, laws, known = [], list(LAW_FORMS), {(law, n) for law, n, _ in L.KNOWN_ARTICLES}
    for i, (law, n, _) in enumerate(L.KNOWN_ARTICLES):
        rows += [("artigo real", f"Nos termos do {a} {form}, procede.", "real") for form in LAW_FORMS[law] for a in (f"art. {n}", f"artigo {n}º, I,")]
        other = laws[(laws.index(law) + 1 + i) % len(laws)]
        if other != law and (other, n) not in known:
            rows.append(("artigo em lei errada", f"Nos termos do art. {n} {LAW_FORMS[other][0]}, procede.", "inventada"))
    for i, (court, n, binding, _) in enumerate(L.KNOWN_SUMULAS):
        forms = [f"Súmula Vinculante {n}", f"SV {n}"] if binding else [f"Súmula {n} do {court}", f"Súmula nº {n}/{court}", f"SÚMULA {n} DO {court}"]
        rows += [("súmula real", f"Incide a {form} ao caso.", "real") for form in forms]
        rows.append(("súmula inexistente", f"Incide a Súmula {n + 7 * (i + 1)} do {court}.", "inventada"))
    return _catalogue(spark, rows)


def descriptions(records: DataFrame, size: int | None = 60, seed: int = 42) -> DataFrame:
    """documento_id, texto, tribunal, ano, nome: decisions, a sample of ``size`` or all, told by court, year and rapporteur."""
    rows = records.filter("natureza = 'acordao' and coalesce(relator, '') <> '' and ano is not null")
    if size is not None:
        rows = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(size)
    rows = rows.withColumn("nome", F.replace("relator", F.lit("Min. "), F.lit("")))
    form = F.get(F.array(*map(F.lit, DESCRIPTIONS)), P.pick(F.col("id"), "tell", len(DESCRIPTIONS)))
    for mark, value in (("{t}", F.col("tribunal")), ("{a}", F.col("ano").cast("string")), ("{n}", F.col("nome"))):
        form = F.replace(form, F.lit(mark), value)
    text = F.concat(F.lit("CAB\n\n\nInvoca-se o "), form, F.lit(", no ponto."))
    return rows.select(F.concat_ws("|", F.lit("descrita"), "id").alias("documento_id"), text.alias("texto"), "tribunal", "ano", "nome")


def judged(tests: DataFrame, decide) -> DataFrame:
    """grupo, hits, total: ``decide`` (citations → decisions) on the citations found in synthetic texts.

    A real case has to be found with one of its records; an invented one must not be
    taken for real anywhere in its text.
    """
    # texts are made once and dealt out: those made by a join of small tables would be searched in a few tasks, and again for each kind of citation
    tests = keep(tests.repartition(int(tests.sparkSession.conf.get("spark.sql.shuffle.partitions")), "documento_id"), "tests")
    found = decide(exploded(keep(detect(tests.select("documento_id", "texto")), "detected")))
    both = tests.select("grupo", "documento_id", "classe", "ids").join(found.select("documento_id", "classificacao", "id_canonico"), "documento_id", "left")
    right = (F.col("classificacao") == F.col("classe")) & (F.col("ids").isNull() | F.array_contains("ids", F.col("id_canonico")))
    taken = F.bool_or((F.col("classe") == "inventada") & (F.col("grupo") == "processo inventado") & (F.col("classificacao") == "real"))
    each = both.groupBy("grupo", "documento_id").agg((F.coalesce(F.bool_or(right), F.lit(False)) & ~F.coalesce(taken, F.lit(False))).alias("ok"))
    return each.groupBy("grupo").agg(F.count_if("ok").alias("hits"), F.count("*").alias("total"))
