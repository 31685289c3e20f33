"""What the training-data operators share: scratch tables, Arrow mapping and row schemas."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes that Spark hands to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
#: Characters of a plan's text that are kept.
PLAN_CHARACTERS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and Spark runs inside one machine (tests) is a temporary folder made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """df written to a scratch table and read again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """The scratch tables of one job by name. Each is deleted as soon as what was made of it is written itself, so that the
    shared folder holds a phase's tables and not those of all phases. A job of many tables has many plans: they are
    released with each table, else the driver's heap fills with them to its limit before Java collects them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame, compression: str = "snappy") -> DataFrame:
        """df written as the table ``name`` and read again. The name must be free."""
        if name in self.paths:
            raise ValueError(f"{name} is in use")
        path = scratch(self.spark, name)
        df.write.option("compression", compression).parquet(path)
        self.paths[name] = path
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        context = self.spark.sparkContext
        for name in names:
            path = context._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Ask the driver to drop plans that nothing refers to, so that executors delete their shuffle files before more come."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of one Arrow batch, whatever the length of the texts in it, and of the plans' texts that the driver
    keeps for its listeners."""
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARACTERS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Hand the memory that a finished task has freed back to the machine. Workers are used again, and those that wait for
    a next task would hold the most that any earlier one took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; elsewhere this is left to the allocator
    if trim:
        trim(0)


def map_arrow(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow for a function that yields dicts of columns (lists or Arrow arrays)."""
    spark = df.sparkSession
    small_batches(spark)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for out in each(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip((out[n] for n in arrow.names), arrow, strict=True)], schema=arrow)
        out = None
        give_back()

    return df.mapInArrow(run, schema)


def filter_arrow(df: DataFrame, keep: Callable[[list[bytes | None]], list[bool]], column: str = "text", done: Callable[[], None] | None = None) -> DataFrame:
    """The rows of df, all columns as they are, for which keep says so of the column's UTF-8 bytes. done: called at a
    task's end, to forget what keep remembers."""
    small_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
            yield b.filter(pa.array(keep(texts), pa.bool_()))
        b = texts = None
        if done:
            done()
        give_back()

    return df.mapInArrow(run, df.schema)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the text's UTF-8 bytes only: other columns of any name stay out of the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *more)
