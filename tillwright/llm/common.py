"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwright.session import checkpoint_dir, remember

# Functions of these modules travel to the Python workers by value, so that
# executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows and bytes of an Arrow batch: they bound a Python worker's memory when texts are long.
BATCH_ROWS = 2000
BATCH_BYTES = 64 << 20

# ASCII white space that separates words, and the same as a regex class body.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows handed to a Python worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, label: str, **options) -> DataFrame:
    """Cut lineage: write ``df`` to the cluster's shared folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    remember(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs that identify a row: its id (0 if null) and a hash of its text.

    Ids that are null or repeated still give separate rows unless the texts
    are equal too; rows equal in both have equal results everywhere.
    """
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("_k1"),
            F.xxhash64(F.col(text), F.col(doc_id).isNull()).alias("_k2")]


def worker_state(name: str, make):
    """An object kept for the life of a Python worker process, made on first use."""
    holder = sys.modules.setdefault("tillwright_worker_state", types.ModuleType("tillwright_worker_state"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def give_back() -> None:
    """Free what the allocators of a Python worker hold but do not use.

    An executor keeps the workers of earlier stages and deals tasks out to all of
    them, so memory that each one keeps for later adds up.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
