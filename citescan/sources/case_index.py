"""A stored index of cases: the numbers of a canonical base, parsed once, in buckets by number, merged by record.

Rows are dealt over ``parts`` partitions by a hash of the number and, in each,
over ``buckets`` files by Spark's bucketing. Joins and groups by number read the
buckets as they are, without an exchange; a merge writes only partitions that a
changed record was in or comes to.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citescan.operators import canonical
from citescan.session import keep

ENTRY = "id bigint, tribunal string, numero string, uf string, marcas array<string>, ano int, relator string, part int"


class CaseIndex(NamedTuple):
    spark: SparkSession
    name: str
    parts: int
    buckets: int

    def entries(self) -> DataFrame:
        return self.spark.table(self.name).filter("numero is not null").drop("part")

    def cases(self) -> DataFrame:
        """As ``canonical.cases`` of all records merged so far."""
        return canonical.grouped(self.entries())

    def part(self) -> Column:
        return F.pmod(F.xxhash64("numero"), F.lit(self.parts)).cast("int")

    def merge(self, records: DataFrame) -> list[int]:
        """Put records in place of those with their ids; the partitions that were written, in order.

        A record that is no decision, or names no case, takes its old rows away. Ids that
        ``records`` repeats stay together; null ids replace nothing.
        """
        new = keep(canonical.entries(records).withColumn("part", self.part()), "entries")
        ids = keep(records.select("id").distinct(), "ids")
        table = self.spark.table(self.name)
        before = table.join(ids, "id", "left_semi").select("part")
        # at most ``parts`` numbers
        touched = sorted(r["part"] for r in new.select("part").union(before).distinct().collect())
        if touched:
            stay = table.filter(F.col("part").isin(touched)).filter("numero is not null").join(ids, "id", "left_anti")
            # an overwritten partition has to have a row: one without a number stands for none
            blank = self.spark.range(self.parts).select(F.col("id").cast("int").alias("part")).filter(F.col("part").isin(touched))
            rows = stay.unionByName(new).unionByName(blank, allowMissingColumns=True)
            self._overwrite(keep(rows.select(table.columns), "rewritten"))
        return touched

    def _overwrite(self, rows: DataFrame) -> None:
        """Each task writes one bucket, so a partition has a file for each bucket at most."""
        setting, before = "spark.sql.sources.partitionOverwriteMode", self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set(setting, "dynamic")
        try:
            rows.repartition(self.buckets, "numero").write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set(setting, before)


def create(records: DataFrame, name: str, folder: str, parts: int = 32, buckets: int | None = None) -> CaseIndex:
    """An index of records in a folder that all executors share, as table ``name``; by default as many buckets as shuffles have partitions.

    For a base of b bytes of entries, parts × buckets of b / 128 MB keep files whole; fewer parts make merges write more.
    """
    spark = records.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.createDataFrame([(parts, buckets)], "parts int, buckets int").write.json(f"{folder}/layout")
    index = _table(spark, name, folder, parts, buckets)
    index.merge(records)
    return index


def load(spark: SparkSession, name: str, folder: str) -> CaseIndex:
    """The index in a folder, for a session that has no table of it."""
    layout = spark.read.schema("parts int, buckets int").json(f"{folder}/layout").first()
    index = _table(spark, name, folder, layout["parts"], layout["buckets"])
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return index


def _table(spark: SparkSession, name: str, folder: str, parts: int, buckets: int) -> CaseIndex:
    spark.sql(f"CREATE TABLE {name} ({ENTRY}) USING parquet PARTITIONED BY (part) CLUSTERED BY (numero) INTO {buckets} BUCKETS LOCATION '{folder}/entries'")
    return CaseIndex(spark, name, parts, buckets)
