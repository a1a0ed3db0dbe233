"""The stored index of cases against the cases of all records."""

import glob
import os

from pyspark.sql import functions as F

from citescan.operators import canonical, resolve
from citescan.sources import case_index

MADE = """id, concat('d', id) AS documento_id, IF(id % 2 = 0, 'STJ', 'STF') AS tribunal, 2019 AS ano, concat('Min. ', {name}) AS relator, 'acordao' AS natureza, 't' AS tipo,
  concat('REsp ', {number}, '/SP') AS texto"""


def _made(spark, ids, name="'Ana Barroso'", number="1000000 + id div 3"):
    spark.createDataFrame([(i,) for i in ids], "id long").createOrReplaceTempView("ids")
    return spark.sql(f"SELECT {MADE.format(name=name, number=number)} FROM ids")


def _rows(df):
    return sorted(map(repr, df.select("tribunal", "numero", "ufs", "registros", "menor_id").collect()))


def test_merges_equal_the_cases_of_all_records(spark, tmp_path):
    folder = f"file:{tmp_path}/index"
    first = _made(spark, range(200))
    index = case_index.create(first, "cases_merged", folder, parts=16, buckets=8)
    assert _rows(index.cases()) == _rows(canonical.cases(first))
    files = lambda: {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{tmp_path}/index/entries/part=*/*.parquet")}
    before = files()
    # one record moves to another number, one names no case any more, one is new
    changed = _made(spark, [5, 900], "'Bento Cardoso'", "2000000 + id").unionByName(_made(spark, [7], number="''"))
    touched = index.merge(changed)
    whole = first.filter("id not in (5, 7)").unionByName(changed)
    assert _rows(index.cases()) == _rows(canonical.cases(whole))
    assert 0 < len(touched) <= 4
    written = {p.split("part=")[1].split("/")[0] for p, t in files().items() if before.get(p) != t}
    assert written == {str(p) for p in touched}
    assert index.merge(changed.limit(0)) == []
    # again from the folder, as a new session has it
    again = case_index.load(spark, "cases_loaded", folder)
    assert _rows(again.cases()) == _rows(canonical.cases(whole))
    # all that there is goes
    index.merge(whole.withColumn("natureza", F.lit("sumula")))
    assert index.cases().count() == 0


def test_decisions_by_number_take_the_buckets_as_they_are(spark, tmp_path):
    index = case_index.create(_made(spark, range(60)), "cases_joined", f"file:{tmp_path}/index", parts=4)
    snippets = spark.createDataFrame([(f"REsp {1000000 + i}/SP",) for i in range(25)], "trecho string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = snippets.select(F.explode(F.array("trecho")).alias("numero")).distinct()
        plan = keys.join(index.cases(), "numero")._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and f"SelectedBucketsCount: {index.buckets} out of {index.buckets}" in plan
        # one exchange, of the questions, over as many partitions as there are buckets
        assert plan.count("Exchange ") == 1 and "Exchange hashpartitioning(numero" in plan, plan
        got = {r["trecho"]: (r["classificacao"], r["id_canonico"]) for r in resolve.by_number(snippets, index.cases()).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {r["trecho"]: (r["classificacao"], r["id_canonico"]) for r in resolve.by_number(snippets, canonical.cases(_made(spark, range(60)))).collect()}
    assert got == want and len(got) == 25
