"""The registered queries of the citation operators, each with the SQL that says the same."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citescan.functions import lexicon as L
from citescan.functions import norm as N
from citescan.operators import canonical, evaluate, extract, perturb, resolve, synth, table_function
from citescan.operators import grammar as G
from citescan.plans import corpus as C
from citescan.plans import pipeline
from citescan.session import keep, shared_dir
from citescan.sources import case_index as case_index_table
from citescan.sources import documents, results

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


WITH = f"WITH cases AS ({C.CASES_DUCK}), cited AS ({C.CITED})"
START = len(C.BEFORE)

# ---------------------------------------------------------------- documents and spans

HEADED = r"concat(CASE doc_id % 3 WHEN 0 THEN 'CAB\n\n\n' WHEN 1 THEN 'CAB\n \n' ELSE '' END, coalesce(text, ''))"
END3, END2 = r"(?s)^.*?\r?\n[ \t]*\r?\n[ \t]*\r?\n", r"(?s)^.*?\r?\n[ \t]*\r?\n"


@query(
    f"""WITH t AS (SELECT doc_id, {HEADED.replace("'CAB", "E'CAB")} AS t FROM documents)
    SELECT doc_id, CAST(CASE WHEN regexp_matches(t, '{END3}') THEN length(regexp_extract(t, '{END3}'))
      WHEN regexp_matches(substring(t, 1, 1500), '{END2}') THEN length(regexp_extract(substring(t, 1, 1500), '{END2}')) ELSE 0 END AS INT) AS body_start FROM t"""
)
def doc_body_start(spark, sf_dir):
    C.views(spark, sf_dir)
    rows = spark.sql(f"SELECT doc_id, {HEADED} AS t FROM documents")
    return rows.select("doc_id", extract.body_start(F.col("t")).alias("body_start"))


ID = "concat(CASE doc_id % 4 WHEN 0 THEN 'gen_n1_' WHEN 1 THEN 'gen_N2_' WHEN 2 THEN 'gen_n2_' ELSE 'gen_' END, doc_id)"


@query(f"WITH t AS (SELECT {ID} AS id FROM documents) SELECT id, CASE WHEN contains(lower(id), '_n1_') THEN 1 WHEN contains(lower(id), '_n2_') THEN 2 END AS nivel FROM t")
def doc_level_split(spark, sf_dir):
    C.views(spark, sf_dir)
    return spark.sql(f"SELECT {ID} AS id FROM documents").select("id", extract.level_of(F.col("id")).alias("nivel"))


def _span_sql(pattern: str) -> str:
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    x AS (SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS hit, unnest(string_split_regex(t, '{pattern}')[:-2]) AS gap, generate_subscripts(regexp_extract_all(t, '{pattern}'), 1) AS i FROM t),
    y AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS fim FROM x)
    SELECT doc_id, CAST(fim - length(hit) AS INT) AS inicio, CAST(fim AS INT) AS fim FROM y"""


def _native(spark, sf_dir, pattern):
    C.views(spark, sf_dir)
    spans = extract.native_spans(F.coalesce("text", F.lit("")), pattern)
    return spark.table("documents").select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.*")


NUMBER, EMAIL = "[0-9]+", "[a-z0-9]+@[a-z0-9]+[.][a-z]+"


@query(_span_sql(NUMBER))
def spans_number(spark, sf_dir):
    return _native(spark, sf_dir, NUMBER)


@query(_span_sql(EMAIL))
def spans_email(spark, sf_dir):
    return _native(spark, sf_dir, EMAIL)


SPANS = "SELECT l_orderkey AS k, CAST(l_partkey % 40 AS INT) AS inicio, CAST(-(1 + l_suppkey % 9) AS INT) AS size, l_linenumber AS ordem FROM lineitem"


@query(
    f"""WITH RECURSIVE s AS ({SPANS}), r AS (
      SELECT k, min(struct_pack(i := inicio, z := size, o := ordem)) AS x FROM s GROUP BY k
      UNION ALL
      SELECT r.k, min(struct_pack(i := s.inicio, z := s.size, o := s.ordem)) FROM r JOIN s ON s.k = r.k AND s.inicio >= r.x.i - r.x.z GROUP BY r.k)
    SELECT k, x.i AS inicio, x.i - x.z AS fim FROM r"""
)
def overlap_resolve(spark, sf_dir):
    C.views(spark, sf_dir)
    rows = spark.sql(SPANS).withColumns({c: F.lit("") for c in ("trecho", "tipo", "padrao")})
    spans = rows.groupBy("k").agg(F.collect_list(F.struct("inicio", "size", "ordem", "trecho", "tipo", "padrao")).alias("s"))
    return spans.select("k", F.explode(extract.without_overlaps(F.col("s"))).alias("c")).select("k", "c.inicio", "c.fim")


@query(f"{WITH} SELECT k AS documento_id, {START} AS inicio, CAST({START} + length(snippet) AS INT) AS fim, snippet AS trecho, 'processo' AS padrao FROM cited")
def pattern_process(spark, sf_dir):
    return extract.exploded(extract.detect(C.documents(spark, sf_dir))).select("documento_id", "inicio", "fim", "trecho", "padrao")


def pattern_sql(spark, sf_dir):
    """The same by the table function of SQL."""
    table_function.register(spark)
    C.documents(spark, sf_dir).createOrReplaceTempView("texts")
    return spark.sql("SELECT documento_id, inicio, fim, trecho, padrao FROM texts, LATERAL citations(texto)")


QUERIES["pattern_sql"], ORACLE_SQL["pattern_sql"] = pattern_sql, ORACLE_SQL["pattern_process"]


def _forms(forms: list[tuple[str, str, str]]) -> tuple[str, str]:
    """CASE expressions of snippet and pattern over k, for (snippet expression, pattern, kind)."""
    n = len(forms)
    snippet = " ".join(f"WHEN {i} THEN {s}" for i, (s, _, _) in enumerate(forms))
    pattern = " ".join(f"WHEN {i} THEN '{p}'" for i, (_, p, _) in enumerate(forms))
    return f"CASE k % {n} {snippet} END", f"CASE k % {n} {pattern} END"


def _detected(forms, generic=False):
    snippet, pattern = _forms(forms)

    def run(spark, sf_dir):
        C.cases(spark, sf_dir).createOrReplaceTempView("cases")
        rows = spark.sql(f"SELECT k AS documento_id, concat('CAB\\n\\n\\nNeste ponto, ', {snippet}, '; assim se decide.') AS texto FROM cases")
        return extract.exploded(extract.detect(rows, generic)).select("documento_id", "inicio", "fim", "trecho", "padrao")

    start = len("CAB\n\n\nNeste ponto, ")
    sql = f"WITH cases AS ({C.CASES_DUCK}), t AS (SELECT k, {snippet} AS trecho, {pattern} AS padrao FROM cases) SELECT k AS documento_id, {start} AS inicio, CAST({start} + length(trecho) AS INT) AS fim, trecho, padrao FROM t"
    return run, sql


SMALL = "CAST(1 + k % 400 AS STRING)"
FORMS: dict[str, tuple[list[tuple[str, str, str]], bool]] = {
    "pattern_sumula": (
        [(f"concat('Súmula nº ', {SMALL}, ' do STJ')", "sumula", ""), (f"concat('SV ', {SMALL})", "sumula", ""), (f"concat('SUMULA ', {SMALL}, '/STF')", "sumula", ""),
         (f"concat('verbete n. ', {SMALL}, ' da Súmula do TST')", "sumula", "")], False),
    "pattern_tema_oj": ([(f"concat('Tema ', {SMALL}, ' da repercussão geral')", "tema", ""), (f"concat('OJ ', {SMALL}, ' da SBDI-1')", "orientacao_jurisprudencial", "")], False),
    "pattern_article": (
        [(f"concat('art. ', {SMALL}, ' do CPC')", "dispositivo_legal", ""), (f"concat('artigo ', {SMALL}, ', § 2º, II, da Constituição Federal')", "dispositivo_legal", ""),
         (f"concat('arts. ', {SMALL}, ' da Lei nº 8.078/90')", "dispositivo_legal", "")], False),
    "pattern_cnj": ([("concat(number, '-12.2019.5.02.0031')", "numero_cnj", ""), ("concat('processo nº ', number, '-12.2019.5.02.0031')", "numero_cnj", "")], False),
    "pattern_descriptive": (
        [("concat('julgado do ', court, ' proferido em ', CAST(y AS STRING), ' pela relatoria de ', name)", "decisao_descritiva", ""),
         ("concat('acórdão do ', court, ' de ', CAST(y AS STRING))", "decisao_descritiva", "")], False),
    "pattern_generic": (
        [("concat('pacífica jurisprudência do ', court)", "jurisprudencia_generica", ""), ("concat('entendimento consolidado desta Corte sobre a matéria')", "jurisprudencia_generica", ""),
         ("concat('legislação aplicável à espécie')", "legislacao_generica", "")], True),
}
for _name, (_list, _generic) in FORMS.items():
    QUERIES[_name], _sql = _detected(_list, _generic)
    ORACLE_SQL[_name] = _sql.replace("AS STRING", "AS VARCHAR")

WORD = "CASE k % 6 WHEN 0 THEN 'acórdão' WHEN 1 THEN 'ACORDAO' WHEN 2 THEN 'ac0rda0' WHEN 3 THEN 'acordo' WHEN 4 THEN 'eeórdão' ELSE 'acordão' END"


@query(f"{WITH} SELECT k, k % 6 <> 3 AND k % 6 <> 4 AS fits FROM cases")
def fuzzy_word_match(spark, sf_dir):
    C.cases(spark, sf_dir).createOrReplaceTempView("cases")
    rows = spark.sql(f"SELECT k, {WORD} AS w FROM cases")
    return rows.select("k", F.col("w").rlike("(?iudU)^" + G.tolerant("acórdão") + "$").alias("fits"))


# ---------------------------------------------------------------- normalisation

SCAN = "CASE k % 4 WHEN 0 THEN concat('nº ', number) WHEN 1 THEN concat('1.45g.', number) WHEN 2 THEN concat('000', number, '-122019502OO31') ELSE 'sem' END"
DIGITS = "regexp_replace(translate(x, 'OoDQIlLi|ZzSsGbTBgq', '0000111112255667899'), '[^0-9]', '', 'g')"
KEY = """CASE WHEN d = '' THEN NULL WHEN ltrim(d, '0') = '' THEN '0'
  WHEN length(ltrim(d, '0')) BETWEEN 14 AND 20 AND CAST(substring(ltrim(d, '0'), length(ltrim(d, '0')) - 10, 4) AS INT) BETWEEN 1980 AND 2035
  THEN concat(left(ltrim(d, '0'), length(ltrim(d, '0')) - 13), '-', right(d, 13)) ELSE ltrim(d, '0') END"""


def _scans(spark, sf_dir, expression):
    C.cases(spark, sf_dir).createOrReplaceTempView("cases")
    return spark.sql(f"SELECT k, {expression} AS x FROM cases")


@query(f"{WITH}, t AS (SELECT k, {SCAN} AS x FROM cases) SELECT k, {DIGITS} AS digits FROM t")
def norm_digits(spark, sf_dir):
    return _scans(spark, sf_dir, SCAN).select("k", N.to_digits(F.col("x")).alias("digits"))


@query(f"{WITH}, t AS (SELECT k, {SCAN} AS x FROM cases), u AS (SELECT k, {DIGITS} AS d FROM t), v AS (SELECT k, {KEY} AS key FROM u) SELECT k, key, CASE WHEN contains(key, '-') THEN substring(string_split(key, '-')[2], 7, 1) END AS segment FROM v")
def norm_number_key(spark, sf_dir):
    key = N.number_key(F.col("x"))
    return _scans(spark, sf_dir, SCAN).select("k", key.alias("key"), N.cnj_segment(key).alias("segment"))


PERSON = "concat(CASE k % 4 WHEN 0 THEN 'Min. ' WHEN 1 THEN 'MINISTRA ' WHEN 2 THEN 'Des. Rel. ' ELSE '' END, upper(name), ' d''Ávila  Conceição')"


@query(
    f"{WITH}, t AS (SELECT k, lower(strip_accents({PERSON})) AS x FROM cases) SELECT k, "
    r"trim(regexp_replace(regexp_replace(regexp_replace(x, '\b(?:ministro|ministra|min|desembargador|des|rel)\b\.?', ' ', 'g'), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')) AS person FROM t"
)
def norm_name(spark, sf_dir):
    return _scans(spark, sf_dir, PERSON).select("k", N.person(F.col("x")).alias("person"))


@query("SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '[\\s\\v]+', ' ', 'g')) AS plain FROM documents")
def norm_plain(spark, sf_dir):
    C.views(spark, sf_dir)
    return spark.table("documents").select("doc_id", F.md5(N.plain(F.col("text"))).alias("plain"))


TOLD = "CASE k % 4 WHEN 0 THEN concat('do ', court, ', sim') WHEN 1 THEN 'Súmula do Supremo Tribunal Federal' WHEN 2 THEN 'Tribunal  Superior Eleitoral' ELSE 'stf e XSTJ' END"


@query(f"{WITH} SELECT k, CASE k % 4 WHEN 0 THEN court WHEN 1 THEN 'STF' WHEN 2 THEN 'TSE' END AS court FROM cases")
def norm_court(spark, sf_dir):
    return _scans(spark, sf_dir, TOLD).select("k", N.court_mentioned(F.col("x")).alias("court"))


LAW_TEXT = "CASE k % 6 WHEN 0 THEN 'do cpc' WHEN 1 THEN 'codigo de processo penal militar' WHEN 2 THEN 'da lei complementar no 64/90' WHEN 3 THEN 'carta magna' WHEN 4 THEN 'lei 9.999' ELSE 'da clt e do codigo civil' END"


@query(f"{WITH} SELECT k, CASE k % 6 WHEN 0 THEN 'CPC' WHEN 1 THEN 'CPP' WHEN 2 THEN 'LC64' WHEN 3 THEN 'CF' WHEN 5 THEN 'CLT' END AS law FROM cases")
def norm_law_of(spark, sf_dir):
    return _scans(spark, sf_dir, LAW_TEXT).select("k", N.law_of(F.col("x")).alias("law"))


@query(f"{WITH} SELECT k, CASE WHEN form IN (0, 2, 4) THEN uf END AS uf FROM cited")
def norm_uf(spark, sf_dir):
    return C.cited(spark, sf_dir).select("k", N.uf_at_end(F.col("snippet")).alias("uf"))


CITED_NAME = "CASE k % 4 WHEN 0 THEN lower(name) WHEN 1 THEN concat(substring(lower(name), 1, length(name) - 1), 'x') WHEN 2 THEN concat('z', lower(name)) ELSE 'outra pessoa' END"


@query(
    f"""{WITH}, t AS (SELECT k, lower(name) AS b, {CITED_NAME} AS a FROM cases),
    w AS (SELECT k, unnest(string_split(a, ' ')) AS x, b FROM t), f AS (SELECT k, x, b FROM w WHERE length(x) > 2),
    m AS (SELECT k, x, bool_or(x = y OR (least(length(x), length(y)) >= 5 AND levenshtein(x, y) <= 1)) AS ok FROM (SELECT k, x, unnest(string_split(b, ' ')) AS y FROM f) GROUP BY k, x)
    SELECT k, bool_and(ok) AS same FROM m GROUP BY k"""
)
def fuzzy_person_match(spark, sf_dir):
    C.cases(spark, sf_dir).createOrReplaceTempView("cases")
    rows = spark.sql(f"SELECT k, lower(name) AS b, {CITED_NAME} AS a FROM cases")
    return rows.select("k", N.same_person(F.col("a"), F.col("b")).alias("same"))


# ---------------------------------------------------------------- canonical tables


@query(f"{WITH} SELECT court AS tribunal, number AS numero, uf AS ufs, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'agravo' ELSE 'declaracao' END AS marcas, k AS menor_id FROM cases")
def feito_index(spark, sf_dir):
    rows = canonical.cases(C.records(spark, sf_dir))
    return rows.select("tribunal", "numero", F.array_join("ufs", ",").alias("ufs"), F.array_join(F.get("registros", 0)["marcas"], ",").alias("marcas"), "menor_id")


@query(
    f"""{WITH} SELECT court AS tribunal, number AS numero, uf AS ufs, lower(name) AS relator, CAST(y AS INT) AS ano, k AS menor_id, CAST(1 AS BIGINT) AS n FROM cases"""
)
def case_index(spark, sf_dir):
    """A stored index of the decided orders, the partly decided ones with a stale number and rapporteur; all others and these again are merged into it."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/cases-{uuid.uuid4().hex[:12]}"
    records = keep(C.records(spark, sf_dir).join(spark.table("orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus"), "id", "left"), "records")
    stale = F.col("o_orderstatus") == "P"
    first = records.filter("o_orderstatus <> 'O'").withColumn("relator", F.when(stale, F.lit("Min. Outra Pessoa")).otherwise(F.col("relator"))).withColumn("texto", F.when(stale, F.replace("texto", F.lit("REsp 1"), F.lit("REsp 2"))).otherwise(F.col("texto")))
    index = case_index_table.create(first, f"case_index_{uuid.uuid4().hex[:12]}", folder)
    index.merge(records.filter("o_orderstatus <> 'F'"))
    one = F.get("registros", 0)
    return index.cases().select("tribunal", "numero", F.array_join("ufs", ",").alias("ufs"), one["relator"].alias("relator"), one["ano"].alias("ano"), "menor_id", F.size("registros").cast("long").alias("n"))


def _known(rows, columns: str) -> str:
    """The library's own entries, numbered from 0, as a table of SQL."""
    values = ", ".join(f"({i}, {', '.join(repr(x) if isinstance(x, str) else str(x).lower() for x in r[:-1])})" for i, r in enumerate(rows))
    return f"(VALUES {values}) known(i, {columns})"


@query(
    f"""SELECT CASE p_partkey % 4 WHEN 0 THEN 'STJ' WHEN 1 THEN 'STF' ELSE 'TST' END AS tribunal, CAST(1000 + p_partkey % 500 AS INT) AS numero, p_partkey % 4 = 1 AS vinculante, max(p_partkey) AS id_canonico
    FROM part WHERE p_partkey % 4 <> 3 GROUP BY ALL
    UNION ALL SELECT tribunal, numero, vinculante, min(p_partkey) FROM part JOIN {_known(L.KNOWN_SUMULAS, 'tribunal, numero, vinculante')} ON i = (p_partkey // 4) % {len(L.KNOWN_SUMULAS)}
    WHERE p_partkey % 4 = 3 GROUP BY ALL"""
)
def catalog_sumula(spark, sf_dir):
    return canonical.sumulas(C.catalogue(spark, sf_dir))


@query(
    f"""SELECT CASE s_suppkey % 3 WHEN 0 THEN 'CPC' ELSE 'CF' END AS lei, CAST(1000 + s_suppkey % 50 AS INT) AS artigo, max(-s_suppkey) AS id_canonico FROM supplier WHERE s_suppkey % 3 <> 2 GROUP BY ALL
    UNION ALL SELECT lei, artigo, min(-s_suppkey) FROM supplier JOIN {_known(L.KNOWN_ARTICLES, 'lei, artigo')} ON i = (s_suppkey // 3) % {len(L.KNOWN_ARTICLES)} WHERE s_suppkey % 3 = 2 GROUP BY ALL"""
)
def catalog_article(spark, sf_dir):
    return canonical.articles(C.catalogue(spark, sf_dir))


@query(
    """WITH t AS (SELECT l_orderkey AS k, l_orderkey * 10 + l_linenumber AS id, l_linenumber = 1 AND l_orderkey % 5 = 0 AS titled FROM lineitem)
    SELECT 'STJ' AS tribunal, CAST(k AS INT) AS numero, false AS vinculante, coalesce(max(id) FILTER (titled), min(id)) AS id_canonico FROM t
    WHERE titled OR k IN (SELECT o_orderkey FROM orders) GROUP BY k"""
)
def catalog_large(spark, sf_dir):
    """A catalogue of an entry for each order, looked up in a record for each line of an order; every fifth order has a record with a title too."""
    phrase = lambda k: f"concat('Do pedido ', {k}, ' não se conhece quando a decisão é ', IF({k} % 2 = 0, 'certa', 'nula'))"
    known = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("'STJ' AS tribunal", "CAST(o_orderkey AS INT) AS numero", "false AS vinculante", f"{phrase('o_orderkey')} AS inicio")
    records = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey * 10 + l_linenumber AS id", "'sumula' AS natureza",
        f"concat(IF(l_linenumber = 1 AND l_orderkey % 5 = 0, concat('Súmula nº ', l_orderkey, ' do STJ'), 'sem título'), '\\nTexto. ', upper({phrase('l_orderkey')}), '  e mais.') AS texto",
    )
    return canonical.sumulas(C.dealt(records, "id"), known)


# ---------------------------------------------------------------- decisions


@query(
    f"""{WITH} SELECT k, CASE WHEN form = 3 THEN 'inventada' ELSE 'real' END AS classificacao, CASE WHEN form <> 3 THEN k END AS id_canonico,
    CASE WHEN form = 3 THEN 'processo_inventado' WHEN form = 2 AND regexp_matches(substring(number, 5, 3), '[015]') THEN 'processo_real_ocr' ELSE 'processo_real' END AS regra FROM cited"""
)
def resolve_process(spark, sf_dir):
    rows = C.cited(spark, sf_dir).select("k", F.col("snippet").alias("trecho"))
    base = keep(canonical.cases(C.records(spark, sf_dir)), "cases")
    return rows.join(resolve.by_number(rows.select("trecho").distinct(), base), "trecho").select("k", "classificacao", "id_canonico", "regra")


@query(
    f"""{WITH} SELECT k, CASE WHEN form <> 3 AND court = 'STJ' THEN 'real' ELSE 'inventada' END AS classificacao, CASE WHEN form <> 3 AND court = 'STJ' THEN k END AS id_canonico FROM cited"""
)
def resolve_process_court(spark, sf_dir):
    """Numbers looked up among the cases of one court."""
    rows = C.cited(spark, sf_dir).select("k", F.col("snippet").alias("trecho"))
    base = keep(canonical.cases(C.records(spark, sf_dir)), "cases")
    return rows.join(resolve.by_number(rows.select("trecho").distinct(), base, "STJ"), "trecho").select("k", "classificacao", "id_canonico")


TWO_COURTS = """
  SELECT k, 'STF' AS tribunal, number AS numero, array('SP') AS ufs, array(named_struct('id', k, 'marcas', array('agravo'), 'ano', y, 'relator', name), named_struct('id', -k, 'marcas', CAST(array() AS array<string>), 'ano', y, 'relator', name)) AS registros, -k AS menor_id FROM cases
  UNION ALL SELECT k, CASE WHEN k % 2 = 0 THEN 'STJ' ELSE 'STF ' END, number, array('RJ'), array(named_struct('id', 1000000000 + k, 'marcas', CAST(array() AS array<string>), 'ano', y, 'relator', name)), 1000000000 + k FROM cases"""
TIE = "CASE k % 5 WHEN 0 THEN concat('Rcl ', number, ' do STF') WHEN 1 THEN concat('AgRg na Rcl ', number, '/SP') WHEN 2 THEN concat('HC ', number, '/RJ') WHEN 3 THEN concat('HC ', number) ELSE concat('RE ', number) END"


@query(
    f"""{WITH}, t AS (SELECT k, CASE k % 5 WHEN 0 THEN -k WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 1000000000 + k END WHEN 2 THEN 1000000000 + k WHEN 4 THEN -k END AS id_canonico FROM cases)
    SELECT k, CASE WHEN id_canonico IS NULL THEN 'incompleta' ELSE 'real' END AS classificacao, id_canonico,
      CASE WHEN id_canonico IS NULL THEN 'processo_ambiguo' WHEN k % 5 = 1 AND k % 2 = 0 THEN 'processo_real_uf_divergente' ELSE 'processo_real' END AS regra FROM t"""
)
def resolve_tiebreak(spark, sf_dir):
    C.cases(spark, sf_dir).createOrReplaceTempView("cases")
    rows, base = spark.sql(f"SELECT k, {TIE} AS trecho FROM cases"), spark.sql(TWO_COURTS).drop("k")
    return rows.join(resolve.by_number(rows.select("trecho").distinct(), base), "trecho").select("k", "classificacao", "id_canonico", "regra")


SUMULA_CITED = "CASE k % 6 WHEN 0 THEN 'Súmula 83 do STJ' WHEN 1 THEN 'Súmula Vinculante 10' WHEN 2 THEN concat('Súmula ', CAST(1000 + k AS STRING), ' do STF') WHEN 3 THEN 'Súmula 83' WHEN 4 THEN 'súmula' ELSE 'SÚMULA 33l DO TST' END"
ARTICLE_CITED = "CASE k % 5 WHEN 0 THEN 'art. 373 do CPC' WHEN 1 THEN 'artigo 5º, I, da Constituição Federal' WHEN 2 THEN concat('art. ', CAST(1000 + k AS STRING), ' do CPC') WHEN 3 THEN 'art. 5º da Lei 9.999/99' ELSE 'artigo do CPC' END"


def _by(spark, sf_dir, expression, decide, table):
    C.cases(spark, sf_dir).createOrReplaceTempView("cases")
    rows = spark.sql(f"SELECT k, {expression} AS trecho FROM cases")
    return rows.join(decide(rows.select("trecho").distinct(), table), "trecho").select("k", "classificacao", "id_canonico", "regra")


@query(
    f"""{WITH} SELECT k, CASE k % 6 WHEN 2 THEN 'inventada' WHEN 4 THEN 'incompleta' ELSE 'real' END AS classificacao,
    CAST(CASE k % 6 WHEN 0 THEN -1 WHEN 1 THEN -2 WHEN 3 THEN -1 WHEN 5 THEN -3 END AS BIGINT) AS id_canonico,
    CASE k % 6 WHEN 2 THEN 'sumula_inventada' WHEN 4 THEN 'sumula_sem_numero' ELSE 'sumula_real' END AS regra FROM cases"""
)
def resolve_sumula(spark, sf_dir):
    return _by(spark, sf_dir, SUMULA_CITED, resolve.by_sumula, keep(canonical.sumulas(C.records(spark, sf_dir)), "sumulas"))


@query(
    f"""{WITH} SELECT k, CASE k % 5 WHEN 0 THEN 'real' WHEN 1 THEN 'real' WHEN 4 THEN 'incompleta' ELSE 'inventada' END AS classificacao,
    CAST(CASE k % 5 WHEN 0 THEN -4 WHEN 1 THEN -5 END AS BIGINT) AS id_canonico,
    CASE k % 5 WHEN 2 THEN 'artigo_inexistente' WHEN 3 THEN 'artigo_lei_fora' WHEN 4 THEN 'artigo_sem_numero' ELSE 'artigo_real' END AS regra FROM cases"""
)
def resolve_article(spark, sf_dir):
    return _by(spark, sf_dir, ARTICLE_CITED, resolve.by_article, keep(canonical.articles(C.records(spark, sf_dir)), "articles"))


DESCRIBED = "CASE k % 3 WHEN 0 THEN concat('julgado do ', court, ' proferido em ', CAST(y AS STRING), ' pela relatoria de ', name) WHEN 1 THEN concat('acórdão do ', court, ' de ', CAST(y + 50 AS STRING)) ELSE concat('acórdão do ', court, ' de ', CAST(y AS STRING)) END"


@query(
    f"""{WITH}, a AS (SELECT court, y, name, count(DISTINCT number) AS n, min(k) AS id FROM cases GROUP BY ALL), b AS (SELECT court, y, count(DISTINCT number) AS n, min(k) AS id FROM cases GROUP BY ALL),
    t AS (SELECT k, CASE k % 3 WHEN 0 THEN a.n WHEN 1 THEN 0 ELSE b.n END AS n, CASE k % 3 WHEN 0 THEN a.id WHEN 2 THEN b.id END AS id
      FROM cases JOIN a USING (court, y, name) JOIN b USING (court, y))
    SELECT k, CASE WHEN n = 1 THEN 'real' ELSE 'incompleta' END AS classificacao, CASE WHEN n = 1 THEN id END AS id_canonico,
      CASE WHEN n = 1 THEN 'descricao_unica' WHEN n = 0 THEN 'descricao_sem_correspondencia' ELSE 'descricao_varios' END AS regra FROM t"""
)
def resolve_description(spark, sf_dir):
    return _by(spark, sf_dir, DESCRIBED, resolve.by_description, keep(canonical.cases(C.records(spark, sf_dir)), "cases"))


# k, court, number, name, y: cases of several orders, with rapporteurs that share first names and surnames
SHARED = f"SELECT k, court, CAST(floor(k / 128) AS BIGINT) AS number, CASE (k % 13) % 6 WHEN 0 THEN 'ana barroso' WHEN 1 THEN 'bento barroso' WHEN 2 THEN 'clara dantas' WHEN 3 THEN 'bento dantas' WHEN 4 THEN 'davi barroso esteves' ELSE 'elisa furtado' END AS name, y FROM cases"
#: court, year and name that an order's description tells; a name that starts with a capital
ASKED = """SELECT k, CASE WHEN k % 3 > 0 THEN court END AS qc, CASE WHEN k % 4 > 0 THEN y END AS qy,
  CASE k % 5 WHEN 0 THEN 'Barroso' WHEN 1 THEN 'Bento' WHEN 2 THEN 'Dantas' WHEN 3 THEN 'Davi Esteves' END AS qn FROM s"""
TELLING = "concat('julgado', coalesce(concat(' do ', qc), ''), coalesce(concat(' de ', CAST(qy AS STRING)), ''), coalesce(concat(', da relatoria de ', qn), ''))"


@query(
    f"""{WITH}, s AS ({SHARED}), q AS ({ASKED}), a AS (SELECT DISTINCT qc, qy, qn FROM q), ids AS (SELECT court, number, min(k) AS id FROM s GROUP BY ALL),
    y AS (SELECT DISTINCT court, number, y FROM s), n AS (SELECT DISTINCT court, number, name FROM s),
    f AS (SELECT DISTINCT a.qc, a.qy, a.qn, y.court, y.number FROM a JOIN y ON (qc IS NULL OR qc = y.court) AND (qy IS NULL OR qy = y.y) JOIN n ON n.court = y.court AND n.number = y.number
      AND (qn IS NULL OR name LIKE concat('%', replace(lower(qn), ' ', '% '), '%'))),
    c AS (SELECT qc, qy, qn, count(*) AS n, min(id) AS id FROM f JOIN ids USING (court, number) GROUP BY ALL),
    r AS (SELECT k, coalesce(n, 0) AS n, id FROM q LEFT JOIN c ON q.qc IS NOT DISTINCT FROM c.qc AND q.qy IS NOT DISTINCT FROM c.qy AND q.qn IS NOT DISTINCT FROM c.qn)
    SELECT k, CASE WHEN n = 1 THEN 'real' ELSE 'incompleta' END AS classificacao, CASE WHEN n = 1 THEN id END AS id_canonico,
      CASE n WHEN 1 THEN 'descrição única na base' WHEN 0 THEN 'sem correspondência' ELSE concat(n, ' feitos possíveis') END AS motivo FROM r"""
)
def resolve_description_names(spark, sf_dir):
    """Descriptions whose name means several rapporteurs of cases that have several, all told or left open in turn."""
    C.cases(spark, sf_dir).createOrReplaceTempView("cases")
    spark.sql(SHARED).createOrReplaceTempView("s")
    record = F.struct(F.col("k").alias("id"), F.array().cast("array<string>").alias("marcas"), F.col("y").alias("ano"), F.col("name").alias("relator"))
    base = spark.table("s").groupBy(F.col("court").alias("tribunal"), F.col("number").cast("string").alias("numero")).agg(F.sort_array(F.collect_set(record)).alias("registros"), F.min("k").alias("menor_id"))
    rows = spark.sql(f"SELECT k, {TELLING} AS trecho FROM ({ASKED})")
    return rows.join(resolve.by_description(rows.select("trecho").distinct(), base), "trecho").select("k", "classificacao", "id_canonico", "motivo")


@query(f"{WITH} SELECT k, CASE WHEN k % 2 = 0 THEN 'inventada' ELSE 'incompleta' END AS classificacao, CASE WHEN k % 2 = 0 THEN 'tema_oj: tipo de precedente fora da base' ELSE 'generica: sem identificador' END AS motivo FROM cases")
def resolve_fixed(spark, sf_dir):
    C.cases(spark, sf_dir).createOrReplaceTempView("cases")
    rows = spark.sql("SELECT k, CASE WHEN k % 2 = 0 THEN 'tema' ELSE 'outro' END AS padrao, concat('Tema ', k) AS trecho FROM cases")
    base = C.records(spark, sf_dir)
    return resolve.resolve(rows, canonical.cases(base), canonical.sumulas(base), canonical.articles(base)).select("k", "classificacao", "motivo")


RULES = [*L.CONFIDENCE, "outra"]
RULE = "CASE k % {n} {cases} END".format(n=len(RULES), cases=" ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(RULES)))
CONF = "CASE k % {n} {cases} END".format(n=len(RULES), cases=" ".join(f"WHEN {i} THEN {L.CONFIDENCE.get(r, L.DEFAULT_CONFIDENCE)}" for i, r in enumerate(RULES)))


@query(f"{WITH} SELECT k, CAST({CONF} AS DOUBLE) AS calibrated, CAST(1.0 AS DOUBLE) AS fixed FROM cases")
def confidence_policies(spark, sf_dir):
    rows = _scans(spark, sf_dir, RULE)
    return rows.select("k", resolve.confidence(F.col("x")).alias("calibrated"), resolve.fixed_confidence().alias("fixed"))


# ---------------------------------------------------------------- results

DECIDED = """SELECT l_orderkey AS documento_id, CAST(l_linenumber * 10 AS INT) AS inicio, CAST(l_linenumber * 10 + 5 AS INT) AS fim, concat('t', l_partkey) AS trecho, 'lei' AS tipo,
  CASE l_partkey % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'inventada' ELSE 'incompleta' END AS classificacao, CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey AS BIGINT) END AS id_canonico, CAST(0.9946 AS DOUBLE) AS confianca FROM lineitem"""


@query(
    f"""WITH d AS ({DECIDED}), e AS (SELECT documento_id, string_agg(concat(inicio, ',', fim, ',', classificacao, ',', coalesce(CAST(nullif(id_canonico, 0) AS VARCHAR), '-'), ',0.9946'), '|' ORDER BY inicio, fim, trecho) AS c FROM d GROUP BY 1)
    SELECT o_orderkey AS documento_id, coalesce(c, '-') AS citacoes FROM orders LEFT JOIN e ON o_orderkey = documento_id"""
)
def encode_submission(spark, sf_dir):
    C.views(spark, sf_dir)
    docs = spark.table("orders").select(F.col("o_orderkey").alias("documento_id"))
    return results.submission(results.contract(docs, spark.sql(DECIDED)))


@query(
    f"""WITH d AS ({DECIDED}), n AS (SELECT *, row_number() OVER (PARTITION BY documento_id ORDER BY inicio, fim, trecho) AS i FROM d)
    SELECT documento_id, md5(concat('{{"documento_id":', documento_id, ',"citacoes":[', string_agg(concat('{{"citacao_id":"c', i, '","inicio":', inicio, ',"fim":', fim, ',"trecho":"', trecho, '","tipo":"lei","classificacao":"', classificacao,
      '","resolucao":', CASE WHEN id_canonico IS NULL THEN 'null' ELSE concat('{{"id_canonico":', id_canonico, '}}') END, ',"confianca":0.9946}}'), ',' ORDER BY i), ']}}')) AS object FROM n GROUP BY documento_id"""
)
def json_contract(spark, sf_dir):
    C.views(spark, sf_dir)
    rows = spark.sql(DECIDED)
    return results.contract(rows.select("documento_id").distinct(), rows).select("documento_id", F.md5(results.as_json(F.col("citacoes"))).alias("object"))


# ---------------------------------------------------------------- evaluation

KIND = "CASE {x} % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'inventada' ELSE 'incompleta' END"
LINES = "SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem"
GOLD = f"""SELECT concat('d', CAST(l_orderkey AS STRING), CASE WHEN l_orderkey % 2 = 0 THEN '_n2_' ELSE '_n1_' END) AS documento_id, CAST(i * 100 AS INT) AS inicio, CAST(i * 100 + 10 AS INT) AS fim, 'x' AS trecho,
  CAST(1 + (l_orderkey + 1) % 2 AS INT) AS nivel, {KIND.format(x='l_partkey')} AS classificacao, 'lei' AS tipo, l_partkey, l_suppkey FROM ({LINES}) AS lines"""
#: predictions: shifted by 0 to 7 of 10 characters; some missing, some of another class, some with a wrong id
PRED = """SELECT documento_id, CAST(inicio + l_suppkey % 8 AS INT) AS inicio, CAST(fim + l_suppkey % 8 AS INT) AS fim, trecho, CASE WHEN l_partkey % 7 = 0 THEN 'inventada' ELSE classificacao END AS classificacao,
  CAST(CASE WHEN l_partkey % 7 <> 0 AND classificacao = 'real' THEN l_partkey + CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END END AS BIGINT) AS id_canonico, CAST(0.75 AS DOUBLE) AS confianca,
  CASE WHEN l_partkey % 5 = 0 THEN 'jurisprudencia' ELSE 'lei' END AS tipo, concat('r', CAST(l_suppkey % 4 AS STRING), ': x') AS motivo FROM gold WHERE l_partkey % 13 <> 0"""
EVAL = (
    f"WITH gold AS ({GOLD}), pred AS ({PRED}), "
    "m AS (SELECT g.documento_id, g.nivel, g.classificacao AS g, g.tipo AS gt, g.l_partkey, p.classificacao AS p, p.tipo AS pt, p.motivo, p.id_canonico, p.inicio IS NOT NULL AS has, coalesce(p.inicio - g.inicio <= 3, false) AS pair FROM gold g LEFT JOIN pred p ON p.documento_id = g.documento_id AND p.inicio >= g.inicio AND p.inicio < g.inicio + 100), "
    "h AS (SELECT *, pair AND p = g AND (p <> 'real' OR id_canonico = l_partkey) AS hit, CASE WHEN nivel = 2 THEN 2.0 ELSE 1.0 END AS w FROM m)"
).replace("AS STRING", "AS VARCHAR")


def _sides(spark, sf_dir):
    C.views(spark, sf_dir)
    spark.sql(GOLD).createOrReplaceTempView("gold")
    pred = spark.sql(PRED)
    return pred, spark.table("gold").withColumn("ids_aceitos", F.array(F.col("l_partkey").cast("long"))).drop("l_partkey", "l_suppkey")


RATIOS = "round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1"


def _rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _extraction_sql(pair: str) -> str:
    return f"""{EVAL}, s AS (SELECT documento_id, CAST(count(*) FILTER ({pair}) AS BIGINT) AS tp, CAST(count(*) FILTER (has AND NOT ({pair})) AS BIGINT) AS fp, CAST(count(*) FILTER (NOT ({pair})) AS BIGINT) AS fn FROM m GROUP BY ROLLUP (documento_id))
    SELECT documento_id, tp, fp, fn, {RATIOS} FROM s"""


@query(_extraction_sql("pair"))
def eval_extraction_iou(spark, sf_dir):
    pred, gold = _sides(spark, sf_dir)
    return _rounded(evaluate.extraction(pred, gold))


@query(_extraction_sql("pair AND hit IS NOT NULL AND same").replace("FROM m GROUP", "FROM (SELECT m.*, true AS hit, exists(SELECT 1 FROM pred p WHERE p.documento_id = m.documento_id AND p.inicio = m.gi) AS same FROM m) GROUP").replace("SELECT g.documento_id, g.nivel", "SELECT g.documento_id, g.inicio AS gi, g.nivel", 1))
def eval_exact(spark, sf_dir):
    pred, gold = _sides(spark, sf_dir)
    return _rounded(evaluate.extraction(pred, gold, exact=True))


@query(
    f"""{EVAL}, c AS (SELECT unnest(['real', 'inventada', 'incompleta']) AS classe),
    s AS (SELECT classe, CAST(coalesce(sum(w) FILTER (hit AND g = classe), 0) AS DOUBLE) AS tp, CAST(coalesce(sum(w) FILTER (has AND p = classe AND NOT hit), 0) AS DOUBLE) AS fp, CAST(coalesce(sum(w) FILTER (g = classe AND NOT coalesce(hit, false)), 0) AS DOUBLE) AS fn FROM c, h GROUP BY classe),
    r AS (SELECT classe, tp, fp, fn, {RATIOS} FROM s), n AS (SELECT count(*) FILTER (pair AND gt = pt) AS tipo_corretos, count(*) FILTER (pair) AS pares FROM h)
    SELECT r.*, tipo_corretos, pares, round(avg(f1) OVER (), 9) AS macro_f1 FROM r, n"""
)
def eval_classification(spark, sf_dir):
    pred, gold = _sides(spark, sf_dir)
    return _rounded(evaluate.classification(pred, gold))


OFFICIAL = f"""{EVAL}, c AS (SELECT unnest(['real', 'inventada', 'incompleta']) AS classe),
    s AS (SELECT nivel, classe, 2 * count(*) FILTER (hit AND g = classe) AS tp2, count(*) FILTER (has AND p = classe AND NOT coalesce(hit, false)) AS fp, count(*) FILTER (g = classe AND (NOT pair OR p <> g)) AS fn, count(*) FILTER (g = classe) AS n FROM c, h GROUP BY ALL),
    f AS (SELECT nivel, avg(tp2 / (tp2 + fp + fn)) AS macro_f1 FROM s WHERE n > 0 GROUP BY nivel),
    l AS (SELECT nivel, count(*) FILTER (pair AND g = 'inventada' AND p = 'real') / count(*) FILTER (g = 'inventada') AS tau, avg(CASE WHEN pair THEN CASE WHEN hit THEN 0.0625 ELSE 0.5625 END END) AS brier FROM h GROUP BY nivel),
    o AS (SELECT nivel, macro_f1, tau, greatest(0, least(0.1, 0.1 * (1 - brier))) AS bonus FROM f JOIN l USING (nivel))"""


@query(f"{OFFICIAL} SELECT nivel, round(macro_f1, 9) AS macro_f1, round(CAST(tau AS DOUBLE), 9) AS tau, round(CAST(bonus AS DOUBLE), 9) AS bonus, round(macro_f1 * (1 - 0.5 * tau) * (1 + bonus), 9) AS score FROM o")
def eval_official(spark, sf_dir):
    pred, gold = _sides(spark, sf_dir)
    return _rounded(evaluate.official_levels(pred, gold))


@query(f"{EVAL}, r AS (SELECT substring(motivo, 1, 2) AS regra, count(*) FILTER (hit) AS hits, count(*) AS total FROM h WHERE pair GROUP BY 1) SELECT regra, hits, total, round((hits + 1) / (total + 2), 9) AS laplace, round((hits + 2 * (SELECT sum(hits) / sum(total) FROM r)) / (total + 2), 9) AS shrunk FROM r")
def eval_calibration(spark, sf_dir):
    pred, gold = _sides(spark, sf_dir)
    return _rounded(evaluate.calibration(pred, gold))


#: two overlapping annotations for each line, a prediction as near to one as to the other, one that lies in both and one far away
TIED = "SELECT l_orderkey AS documento_id, CAST(i * 100 AS INT) AS b, l_partkey, {kind} AS kind FROM ({lines}) AS lines".format(kind=KIND.format(x="l_partkey"), lines=LINES)


@query(
    f"""WITH t AS ({TIED}), o AS (SELECT unnest(['evaluation', 'official']) AS judge)
    SELECT judge, documento_id, b + 2 AS p, CASE judge WHEN 'official' THEN b ELSE b + 4 END AS g, CASE judge WHEN 'official' THEN kind <> 'real' OR l_partkey % 11 <> 0 ELSE kind = 'incompleta' END AS hit, false AS spare FROM t, o
    UNION ALL SELECT judge, documento_id, b + 5, NULL, false, true FROM t, o UNION ALL SELECT judge, documento_id, b + 50, NULL, false, false FROM t, o
    UNION ALL SELECT judge, documento_id, NULL, CASE judge WHEN 'official' THEN b + 4 ELSE b END, false, false FROM t, o"""
)
def eval_ties(spark, sf_dir):
    C.views(spark, sf_dir)
    spark.sql(TIED).createOrReplaceTempView("tied")
    gold = spark.sql(
        """SELECT documento_id, b AS inicio, b + 10 AS fim, 1 AS nivel, kind AS classificacao, array(CAST(l_partkey AS LONG)) AS ids_aceitos FROM tied
        UNION ALL SELECT documento_id, b + 4, b + 14, 1, 'incompleta', CAST(array() AS array<bigint>) FROM tied"""
    )
    pred = spark.sql(
        """SELECT documento_id, b + 2 AS inicio, b + 12 AS fim, kind AS classificacao, CAST(l_partkey + CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS LONG) AS id_canonico FROM tied
        UNION ALL SELECT documento_id, b + 5, b + 8, kind, NULL FROM tied UNION ALL SELECT documento_id, b + 50, b + 60, kind, NULL FROM tied"""
    )
    both = keep(evaluate.side_by_side(pred.withColumn("documento_id", F.col("documento_id").cast("string")), gold.withColumn("documento_id", F.col("documento_id").cast("string"))), "sides")
    found = [evaluate.outcomes(both, late).select(F.lit(judge).alias("judge"), F.col("documento_id").cast("long").alias("documento_id"), F.col("p.inicio").alias("p"), F.col("g.inicio").alias("g"), "hit", "spare") for judge, late in (("evaluation", True), ("official", False))]
    return found[0].union(found[1])


# ---------------------------------------------------------------- sources and sinks


@query(
    """WITH n AS (SELECT n_nationkey AS k, CAST('n' || n_nationkey AS VARCHAR) AS id, n_name, n_regionkey AS r FROM nation)
    SELECT 'texts' AS source, id, concat(E'CAB\n\n\n', n_name) AS a, CAST(6 + length(n_name) AS BIGINT) AS b FROM n
    UNION ALL SELECT 'annotations', id, concat(n_name, E'\nx'), CAST(r AS BIGINT) FROM n
    UNION ALL SELECT 'gold', id, concat(n_name, E'\nx'), CAST(6 + length(n_name) AS BIGINT) FROM n
    UNION ALL SELECT 'base', id, n_name, CAST(1990 + r AS BIGINT) FROM n
    UNION ALL SELECT 'json', id, n_name, CASE WHEN r > 0 THEN CAST(k AS BIGINT) END FROM n
    UNION ALL SELECT unnest(['csv', 'converted']), id, concat('6,', 6 + length(n_name), ',', CASE WHEN r > 0 THEN concat('real,', CASE WHEN k = 0 THEN '-' ELSE CAST(k AS VARCHAR) END) ELSE 'incompleta,-' END, ',0.5000'), CAST(NULL AS BIGINT) FROM n"""
)
def sources_and_sinks(spark, sf_dir):
    """A folder of texts, a file of annotations, a SQLite base and both kinds of results, written from ``nation`` and read again."""
    folder = f"{shared_dir(spark).removeprefix('file:').replace('//', '/')}/{spark.sparkContext.applicationId}/sources-{uuid.uuid4().hex[:12]}"
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS k", "concat('n', n_nationkey) AS documento_id", "n_name", "n_regionkey AS r")
    texts = nations.selectExpr("documento_id", "concat('CAB\\n\\n\\n', n_name) AS texto")
    documents.write_texts(texts, f"{folder}/txt")
    marked = nations.selectExpr(
        "1 AS nivel", "documento_id", "'g1' AS citacao_id", "6 AS inicio", "6 + length(n_name) AS fim", r"concat(n_name, '\\n', 'x') AS trecho", "'lei' AS tipo", "'real' AS classificacao", "concat(k, '  ', r) AS id_canonico"
    )
    # every annotation twice, on two levels
    marked.union(marked.withColumn("nivel", F.lit(2))).coalesce(1).write.csv(f"{folder}/gold", header=True, escape='"')
    base = nations.selectExpr("CAST(k AS LONG) AS id", "documento_id", "n_name AS tribunal", "1990 + r AS ano", "CAST(NULL AS STRING) AS relator", "'acordao' AS natureza", "'acordao' AS tipo", "n_name AS texto")
    documents.write_base(base, f"{folder}/base.db")
    decided = nations.selectExpr(
        "documento_id", "6 AS inicio", "6 + length(n_name) AS fim", "n_name AS trecho", "'lei' AS tipo", "IF(r > 0, 'real', 'incompleta') AS classificacao", "IF(r > 0, CAST(k AS LONG), NULL) AS id_canonico", "CAST(0.5 AS DOUBLE) AS confianca"
    )
    done = results.contract(texts, decided)
    results.write_files(done, f"{folder}/json")
    results.write_submission(done, f"{folder}/csv")
    marks = documents.read_annotations(spark, f"{folder}/gold")
    read = [
        documents.read_texts(spark, f"{folder}/txt").select(F.lit("texts").alias("source"), F.col("documento_id").alias("id"), F.col("texto").alias("a"), F.length("texto").cast("long").alias("b")),
        marks.filter("nivel = 1").select(F.lit("annotations"), "documento_id", "trecho", F.get("ids_aceitos", 1)),
        documents.gold_spans(marks).select(F.lit("gold"), "documento_id", "trecho", F.col("fim").cast("long")),
        documents.read_base(spark, f"{folder}/base.db").select(F.lit("base"), "documento_id", "texto", F.col("ano").cast("long")),
        documents.read_results(spark, f"{folder}/json").select(F.lit("json"), "documento_id", F.get("citacoes", 0)["trecho"], F.get("citacoes", 0)["resolucao"]["id_canonico"]),
        spark.read.csv(f"{folder}/csv", header=True).select(F.lit("csv"), "documento_id", "citacoes", F.lit(None).cast("long")),
        results.submission_of_files(spark, f"{folder}/json").select(F.lit("converted"), "documento_id", "citacoes", F.lit(None).cast("long")),
    ]
    return functools.reduce(DataFrame.union, read)


# ---------------------------------------------------------------- noise and synthesis


def _noise(name: str, back, truth: str, sure: bool = True):
    """Which snippets a noise changes, and that undoing it gives the snippet again.

    Where a form that it may choose is the one that is there, it is ``sure`` only that no other snippet changes, and that many of these do.
    """

    def run(spark, sf_dir):
        rows = C.cited(spark, sf_dir).select("k", "form", "snippet").withColumn("noisy", perturb.NOISES[name](F.col("snippet"), F.col("k")))
        changed = F.col("noisy") != F.col("snippet")
        same = (back(F.col("noisy")) == back(F.col("snippet"))).alias("same")
        if sure:
            return rows.select("k", changed.alias("changed"), same)
        # one row
        many = rows.filter(truth).agg((F.avg(changed.cast("int")) > 0.25).alias("many"))
        return rows.crossJoin(F.broadcast(many)).select("k", (changed & ~F.expr(truth)).alias("stray"), "many", same)

    QUERIES[f"noise_{name}"] = run
    ORACLE_SQL[f"noise_{name}"] = f"{WITH} SELECT k, {f'{truth} AS changed' if sure else 'false AS stray, true AS many'}, true AS same FROM cited"


_noise("upper_case", F.upper, "form <> 3")
_noise("line_break", lambda c: F.replace(c, F.lit("\n"), F.lit(" ")), "true")
_noise("ocr", lambda c: F.translate(F.replace(c, F.lit("rn"), F.lit("m")), "OlSsZGTBg", "015526789"), "true")
_noise("abbreviation", lambda c: F.regexp_extract(c, "[0-9].*$", 0), "true")
_noise("number_format", lambda c: F.regexp_replace(c, r"(?<=[0-9])[. ]+(?=[0-9])", ""), "form IN (1, 4)")
_noise("number_marker", lambda c: F.regexp_replace(c, r" (?:n[º°.]|N[oº]|número) ", " # "), "form IN (0, 2, 4)", sure=False)
_noise("uf_separator", lambda c: F.regexp_replace(c, r"\W+([A-Z]{2})\)?$", "/$1"), "form IN (0, 2, 4)", sure=False)


@query(f"SELECT noise, count(*) AS variants, true AS found FROM orders, (SELECT unnest([{', '.join(map(repr, perturb.NOISES))}]) AS noise) GROUP BY 1")
def noise_recall(spark, sf_dir):
    """Whether 99 of 100 cited snippets are still found where each noise has put them."""
    rows = C.cited(spark, sf_dir).select("k", "snippet")
    noisy = [rows.select(F.lit(n).alias("noise"), "k", make(F.col("snippet"), F.col("k")).alias("snippet")) for n, make in perturb.NOISES.items()]
    return perturb.recall_by(functools.reduce(DataFrame.union, noisy), "noise", "k", "snippet", C.BEFORE, C.AFTER)


@query("SELECT count(*) > 0 AS any, true AS found FROM orders")
def noise_recall_mixed(spark, sf_dir):
    """The same for up to three noises on top of each other."""
    docs = C.documents(spark, sf_dir)
    gold = C.cited(spark, sf_dir).select(F.col("k").alias("documento_id"), F.lit(START).alias("inicio"), (F.lit(START) + F.length("snippet")).alias("fim"), F.col("snippet").alias("trecho"))
    return perturb.robustness(docs, gold).select((F.col("variants") > 0).alias("any"), (F.col("recall") >= 0.99).alias("found"))


def _decide(spark, sf_dir):
    """The cases of the base, parsed once, and the decisions on citations by them."""
    base = C.records(spark, sf_dir)
    cases = keep(canonical.cases(base), "cases")
    return cases, lambda citations: resolve.resolve(citations, cases, canonical.sumulas(base), canonical.articles(base))


@query("SELECT 'processo real' AS grupo, count(*) AS hits, count(*) AS total FROM orders")
def synthetic_real(spark, sf_dir):
    cases, decide = _decide(spark, sf_dir)
    return synth.judged(synth.real_cases(cases), decide)


@query("SELECT 'processo inventado' AS grupo, 0 AS missed, count(*) > 0 AS any FROM orders")
def synthetic_mutated(spark, sf_dir):
    cases, decide = _decide(spark, sf_dir)
    found = synth.judged(synth.invented_cases(cases, cases), decide)
    return found.select("grupo", (F.col("total") - F.col("hits")).cast("int").alias("missed"), (F.col("total") > 0).alias("any"))


@query("SELECT 'processo real com ruído' AS grupo, true AS found, count(*) AS total FROM orders")
def synthetic_noisy(spark, sf_dir):
    cases, decide = _decide(spark, sf_dir)
    found = synth.judged(synth.real_cases(cases, noisy=True), decide)
    return found.select("grupo", (F.col("hits") >= 0.99 * F.col("total")).alias("found"), "total")


@query("SELECT * FROM (VALUES ('artigo real', 16, 60), ('artigo em lei errada', 12, 12), ('súmula real', 11, 14), ('súmula inexistente', 5, 5)) t(grupo, hits, total)")
def synthetic_catalogue(spark, sf_dir):
    return synth.judged(synth.catalogue(spark), _decide(spark, sf_dir)[1])


@query(
    f"""{WITH}, n AS (SELECT court, y, name, count(DISTINCT number) AS n, min(k) AS id FROM cases GROUP BY ALL)
    SELECT 'descrita|' || k AS documento_id, CASE WHEN n = 1 THEN 'real' ELSE 'incompleta' END AS classificacao, CASE WHEN n = 1 THEN id END AS id_canonico,
      CASE WHEN n = 1 THEN 'descricao_unica' ELSE 'descricao_varios' END AS regra FROM cases JOIN n USING (court, y, name)"""
)
def synthetic_description(spark, sf_dir):
    """Every decision told by court, year and rapporteur, against the number of cases that fit."""
    base = C.records(spark, sf_dir)
    told = keep(synth.descriptions(base, size=None), "told")
    return pipeline.run(told.select("documento_id", "texto"), base).select("documento_id", "classificacao", "id_canonico", "regra")


# ---------------------------------------------------------------- the whole plan


@query(f"{WITH}, t AS (SELECT CASE WHEN form = 3 THEN 'inventada' ELSE 'real' END AS classificacao FROM cited) SELECT classificacao, count(*) AS n FROM t GROUP BY 1")
def pipeline_class_counts(spark, sf_dir):
    decided = pipeline.run(C.documents(spark, sf_dir), C.records(spark, sf_dir))
    return decided.groupBy("classificacao").agg(F.count("*").alias("n"))
