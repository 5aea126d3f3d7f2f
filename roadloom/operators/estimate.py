"""What a scan will read, from Parquet footers.

Footer rows: file_name, row_group_id, path_in_schema, total_compressed_size,
mn, mx (numeric statistics) and text_min, text_max (string statistics).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.constants import DIVISION_LEAVES, SEGMENT_LEAVES

GROUP = ["file_name", "row_group_id"]


def _bound(leaf: str, which: str, x: str):
    return F.max(F.when(F.col("path_in_schema") == leaf, F.col(which))).alias(x)


def row_groups(footers: DataFrame, area, x_leaf: str = "bbox, xmin", y_leaf: str = "bbox, ymin") -> DataFrame:
    """One row per row group with the flags ``kept`` (its ranges overlap the
    area) and ``no_statistics`` (nothing is known, so it cannot be kept)."""
    x0, y0, x1, y1 = area
    ranges = footers.groupBy(*GROUP).agg(
        _bound(x_leaf, "mn", "x_lo"), _bound(x_leaf, "mx", "x_hi"),
        _bound(y_leaf, "mn", "y_lo"), _bound(y_leaf, "mx", "y_hi"))
    overlap = ((F.col("x_hi") >= x0) & (F.col("x_lo") <= x1) & (F.col("y_hi") >= y0) & (F.col("y_lo") <= y1))
    unknown = (F.col("x_lo").isNull() | F.col("x_hi").isNull() | F.col("y_lo").isNull() | F.col("y_hi").isNull())
    return ranges.select(*GROUP, F.coalesce(overlap, F.lit(False)).alias("kept"), unknown.alias("no_statistics"))


def estimate(footers: DataFrame, area, leaves: list[str] = SEGMENT_LEAVES,
             x_leaf: str = "bbox, xmin", y_leaf: str = "bbox, ymin", by: list[str] | None = None) -> DataFrame:
    """Row groups to read, row groups in total, and bytes of the wanted columns.

    Sizes are reduced to one row per row group before the flags are joined."""
    by = by or []
    wanted = F.sum(F.when(F.col("path_in_schema").isin(leaves), F.col("total_compressed_size")))
    sizes = footers.groupBy(*by, *GROUP).agg(F.coalesce(wanted, F.lit(0)).alias("bytes"))
    flags = row_groups(footers, area, x_leaf, y_leaf)
    return sizes.join(flags, GROUP).groupBy(*by).agg(
        F.count_if(F.col("kept")).alias("groups_kept"), F.count(F.lit(1)).alias("groups_total"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if(F.col("no_statistics")).alias("groups_without_statistics"))


def kept_footers(footers: DataFrame, area, **leaf_names) -> DataFrame:
    """Footer rows of the row groups that will be read."""
    keep = row_groups(footers, area, **leaf_names).where("kept").select(*GROUP)
    return footers.join(keep, GROUP, "left_semi")


def estimate_boundaries(footers: DataFrame, country: str = "DE", leaves: list[str] = DIVISION_LEAVES,
                        leaf: str = "country") -> DataFrame:
    """Bytes of the row groups whose country range can contain ``country``."""
    holds = footers.where((F.col("path_in_schema") == leaf) & (F.col("text_min") <= country)
                          & (F.col("text_max") >= country)).select(*GROUP)
    return (footers.join(holds, GROUP, "left_semi").where(F.col("path_in_schema").isin(leaves))
            .agg(F.coalesce(F.sum("total_compressed_size"), F.lit(0)).cast("bigint").alias("bytes")))
