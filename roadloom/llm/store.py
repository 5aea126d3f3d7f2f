"""Shared scratch tables, and helpers that several operators use."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts: space and U+0009 to U+000D.  Python's bytes.split() and
#: bytes.translate() see the same six bytes.
WHITE = b" \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one under the warehouse, which is shared as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts the lineage, is computed once, and survives any lost executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text as UTF-8 bytes): the only columns the operators look at, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))


def parts(spark: SparkSession) -> int:
    """How many partitions a shuffle has; what is dealt out by hand follows it, so that it grows with the cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Hand the memory that this worker has freed back to the system.  Spark keeps Python workers for later tasks, and the
    allocators of Arrow and of the C library would hold what the largest block has taken, beside all that run next to them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(work: Callable[..., pa.Table], *tables: pa.Table) -> pa.Table:
    """The result of ``work``; after large groups, what it has freed is given back."""
    out = work(*tables)
    if sum(t.nbytes for t in tables) > 1 << 22:
        give_back()
    return out
