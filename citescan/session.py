"""Session helpers: a local test session and tables kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A private one is made only where the setting is absent (tests, local mode).
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="citescan-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: settings while a table is kept: its shuffle files go when it is written, and batches to and from Python stay small
WHILE_KEPT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1024"}


def keep(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage and survives the loss of any executor,
    and later reads of it prune columns. Its shuffle files go once it is written.
    Tables of one application sit under one folder named by its id, which whoever
    owns the shared folder may drop when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    before = {name: spark.conf.get(name) for name in WHILE_KEPT}
    for name, value in WHILE_KEPT.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path, compression=compression)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` has written and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
