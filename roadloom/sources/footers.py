"""Parquet footers as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs
import pyarrow.parquet as pq
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = ("file_name string, row_group_id int, path_in_schema string, total_compressed_size bigint, "
           "text_min string, text_max string")


def _text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    return str(value)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for uri in batch["path"]:
            uri_ = uri.replace("s3a://", "s3://", 1)
            local = uri_.removeprefix("file://").removeprefix("file:")
            fs, name = (pafs.LocalFileSystem(), local) if local.startswith("/") else pafs.FileSystem.from_uri(uri_)
            with fs.open_input_file(name) as f:
                meta = pq.ParquetFile(f).metadata
            rows = []
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                for c in range(group.num_columns):
                    col = group.column(c)
                    stats = col.statistics
                    known = stats is not None and stats.has_min_max
                    rows.append((uri, g, ", ".join(col.path_in_schema.split(".")), col.total_compressed_size,
                                 _text(stats.min) if known else None, _text(stats.max) if known else None))
            yield pd.DataFrame(rows, columns=["file_name", "row_group_id", "path_in_schema",
                                              "total_compressed_size", "text_min", "text_max"])


def scan_footers(spark: SparkSession, path: str, leaves: list[str] | None = None) -> DataFrame:
    """One row per (file, row group, leaf column): compressed bytes, numeric
    minimum and maximum (null for other types), and the same as text.

    Executors read the footers; file contents are not touched.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.parquet").load(path).select("path"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = files.repartition(n, "path").mapInPandas(_read, _SCHEMA)
    if leaves is not None:
        rows = rows.where(F.col("path_in_schema").isin(leaves))
    return rows.select("file_name", "row_group_id", "path_in_schema", "total_compressed_size",
                       F.col("text_min").try_cast("double").alias("mn"),
                       F.col("text_max").try_cast("double").alias("mx"), "text_min", "text_max")


def cache_footers(footers: DataFrame, path: str) -> DataFrame:
    """Write the footer table once; later estimates read it."""
    footers.write.mode("overwrite").parquet(path)
    return footers.sparkSession.read.parquet(path)
