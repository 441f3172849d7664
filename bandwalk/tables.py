"""Tables written to the folder that the cluster shares: they cut lineage and survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    base = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/bandwalk-{spark.sparkContext.applicationId}"
        spark.conf.set(CHECKPOINT_KEY, base)
    return f"{base.rstrip('/')}/bandwalk/{name}-{uuid.uuid4().hex}"


def put(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it back; the files that it shuffled go with the write instead of waiting for the driver's collector."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_KEY)
    conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP_KEY, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` from a table of its own, and the table's path."""
    path = shared_path(df.sparkSession, name)
    return put(df, path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
