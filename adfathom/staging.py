"""Tables written once and read back by several jobs.

A staged table is plain Parquet in the shared folder named by ``spark.checkpoint.dir``. It
survives lost executors, cuts lineage, and lets later scans prune columns and push filters.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from adfathom.schema import EngineError


def staging_root(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise EngineError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    return named.rstrip("/")


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` and return a scan of it."""
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """`df` in as many even parts as the session shuffles into, for a table that many scans read."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
