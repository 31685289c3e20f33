"""Tables in the folder that the cluster shares, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder only where Spark runs inside one machine without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, rows: int = 20_000) -> DataFrame:
    """The rows of a table by keys in tasks of about ``rows`` rows each, where a row costs far more than its bytes tell.

    A narrow table of millions of rows is a few megabytes, and so one task's input by size. df should be a table that is
    cheap to count, as it is read twice.
    """
    return df.repartition(max(1, -(-df.count() // rows)), *keys)
