"""Citations made from the order tables by SQL that Spark and other engines read alike.

Orders play cases: the order key is the case's number, the customer gives court,
state and rapporteur, the order date the year. Each order also writes a sentence
that cites a case in one of several ways, so what should be found in it and
decided on it is known from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citescan.functions import lexicon as L

TABLES = ("orders", "customer", "nation", "lineitem", "documents")

COURT = "CASE {c} % 5 WHEN 0 THEN 'STF' WHEN 1 THEN 'STJ' WHEN 2 THEN 'TST' WHEN 3 THEN 'TSE' ELSE 'STM' END"
UF = "CASE {n} % 6 WHEN 0 THEN 'SP' WHEN 1 THEN 'RJ' WHEN 2 THEN 'MG' WHEN 3 THEN 'RS' WHEN 4 THEN 'BA' ELSE 'DF' END"
NAME = "CASE {c} % 7 WHEN 0 THEN 'Ana Barroso' WHEN 1 THEN 'Bento Cardoso' WHEN 2 THEN 'Clara Dantas' WHEN 3 THEN 'Davi Esteves' WHEN 4 THEN 'Elisa Furtado' WHEN 5 THEN 'Fausto Gouveia' ELSE 'Gilda Horta' END"

#: k, court, uf, name, year, number: a case for each order
CASES = f"""
  SELECT o_orderkey AS k, {COURT.format(c='o_custkey')} AS court, {UF.format(n='c_nationkey')} AS uf, {NAME.format(c='o_custkey')} AS name,
         year(o_orderdate) AS y, CAST(1000000 + o_orderkey AS STRING) AS number
  FROM orders JOIN customer ON o_custkey = c_custkey"""
CASES_DUCK = CASES.replace("AS STRING", "AS VARCHAR")

DOTTED = "concat(substring(number, 1, 1), '.', substring(number, 2, 3), '.', substring(number, 5, 3))"
SCANNED = "concat(substring(number, 1, 4), translate(substring(number, 5, 3), '015', 'OlS'))"
INVENTED = "concat('9', number)"
BEFORE, AFTER = "CAB\n\n\nConforme o ", ", nega-se provimento."

#: k, snippet, form: each order cites its own case, or one that does not exist
CITED = f"""
  SELECT k, court, uf, name, y, number, k % 5 AS form,
         CASE k % 5 WHEN 0 THEN concat('Recurso Especial nº ', number, '/', uf) WHEN 1 THEN concat('REsp ', {DOTTED})
                    WHEN 2 THEN concat('Rcl n. ', {SCANNED}, ' - ', uf) WHEN 3 THEN concat('HC ', {INVENTED})
                    ELSE concat('AgInt no REsp nº ', {DOTTED}, ' (', uf, ')') END AS snippet
  FROM cases"""


def views(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(CASES)


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases(spark, sf_dir).createOrReplaceTempView("cases")
    return spark.sql(CITED)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precedents made from the parts and articles made from the suppliers, a quarter or a third of them told by their text alone."""
    for name in ("part", "supplier"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    text = lambda known, key, every: f"element_at(array({', '.join(repr(k[-1]) for k in known)}), cast(({key} div {every}) % {len(known)} + 1 as int))"
    return spark.sql(f"""
      SELECT id, concat('cat_', id) AS documento_id, CAST(NULL AS STRING) AS tribunal, CAST(NULL AS INT) AS ano, CAST(NULL AS STRING) AS relator, natureza, natureza AS tipo, concat(titulo, chr(10), resto) AS texto
      FROM (
        SELECT p_partkey AS id, 'sumula' AS natureza, p_name AS nome,
               CASE p_partkey % 4 WHEN 0 THEN concat('Súmula nº ', 1000 + p_partkey % 500, ' do STJ') WHEN 1 THEN concat('SUMULA vinculante n. ', 1000 + p_partkey % 500, ' do STF')
                 WHEN 2 THEN concat('súmula n', 1000 + p_partkey % 500, ' da TST') ELSE 'sem título' END AS titulo,
               CASE WHEN p_partkey % 4 = 3 THEN concat(p_name, '. ', {text(L.KNOWN_SUMULAS, 'p_partkey', 4)}, ' e mais') ELSE p_name END AS resto FROM part
        UNION ALL
        SELECT -s_suppkey, 'dispositivo', s_name,
               CASE s_suppkey % 3 WHEN 0 THEN concat('Artigo ', 1000 + s_suppkey % 50, ' do Código de Processo Civil') WHEN 1 THEN concat('ARTIGO ', 1000 + s_suppkey % 50, 'º da Constituição Federal')
                 ELSE 'sem título' END,
               CASE WHEN s_suppkey % 3 = 2 THEN upper({text(L.KNOWN_ARTICLES, 's_suppkey', 3)}) ELSE s_name END FROM supplier)""")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key over all shuffle partitions: texts made by a join of small tables would go to one task, where a pass over them takes longer than making them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical base: a decision for each order, some precedents and articles."""
    cases(spark, sf_dir).createOrReplaceTempView("cases")
    decisions = """
      SELECT k AS id, concat('doc_', k) AS documento_id, court AS tribunal, y AS ano, concat('Min. ', name) AS relator, 'acordao' AS natureza, 'acordao' AS tipo,
             concat(CASE k % 3 WHEN 0 THEN 'REsp ' WHEN 1 THEN 'AgRg no REsp ' ELSE 'EDcl no REsp ' END, number, '/', uf, '\\nEMENTA. Texto.') AS texto
      FROM cases"""
    titles = """
      SELECT CAST(-n AS BIGINT) AS id, concat('cat_', n) AS documento_id, CAST(NULL AS STRING) AS tribunal, CAST(NULL AS INT) AS ano, CAST(NULL AS STRING) AS relator, natureza, natureza AS tipo, texto
      FROM VALUES (1, 'sumula', 'Súmula nº 83 do STJ\\nNão se conhece.'), (2, 'sumula', 'Súmula vinculante nº 10 do STF\\nViola.'), (3, 'sumula', 'Súmula nº 331 do TST\\nContrato.'),
        (4, 'dispositivo', 'Artigo 373 do Código de Processo Civil'), (5, 'dispositivo', 'Artigo 5º da Constituição Federal'), (6, 'dispositivo', 'sem título\\nArt. 186. Aquele que, por ação ou omissão, causar dano'),
        (7, 'sumula', 'sem título\\nInadmissível recurso especial quanto à questão que não foi') AS t(n, natureza, texto)"""
    return dealt(spark.sql(decisions + " UNION ALL " + titles), "id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documento_id, texto: a sentence for each order."""
    rows = cited(spark, sf_dir)
    rows.createOrReplaceTempView("cited")
    return dealt(spark.sql(f"SELECT k AS documento_id, concat('{BEFORE}', snippet, '{AFTER}') AS texto FROM cited".replace("\n", "\\n")), "documento_id")
