"""Grid cells to regions.

Points are looked up once per 0.01 degree cell.  Each region is turned into
horizontal intervals, one or more per grid row; a cell is inside if it falls
into one of the intervals of its row.  Rows are cut into tiles one degree wide,
so the lookup is an equi join on (row, tile) in which a bucket holds at most
100 cells: no nested loop, and nothing has to fit into memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.constants import CELLS_PER_DEGREE, OUTSIDE
from roadloom.functions import geo
from roadloom.operators.skew import hot_among, skew_join

TILE = CELLS_PER_DEGREE


def row_crossings(edges: DataFrame, region: str = "state") -> DataFrame:
    """Where each polygon edge crosses a grid row: ``region, cy, at``."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = F.sequence(F.floor(low * CELLS_PER_DEGREE) - 1, F.ceil(high * CELLS_PER_DEGREE) + 1)
    py = F.col("cy") / F.lit(float(CELLS_PER_DEGREE))
    return (edges.where(F.col("y1") != F.col("y2"))
            .select("*", F.explode(rows).alias("cy"))
            .where((F.col("y1") > py) != (F.col("y2") > py))
            .select(region, F.col("cy").cast("bigint").alias("cy"),
                    (F.col("x1") + (py - F.col("y1")) * (F.col("x2") - F.col("x1"))
                     / (F.col("y2") - F.col("y1"))).alias("at")))


def row_intervals(edges: DataFrame, region: str = "state") -> DataFrame:
    """Inside intervals ``[x_from, x_to)`` per region and grid row, cut into tiles.

    Crossings are paired in order of x, so holes and several rings per region
    come out right (even-odd rule).
    """
    order = Window.partitionBy(region, "cy").orderBy("at")
    paired = (row_crossings(edges, region)
              .withColumn("i", F.row_number().over(order))
              .withColumn("x_to", F.lead("at").over(order))
              .where(F.col("i") % 2 == 1)
              .select(region, "cy", F.col("at").alias("x_from"), "x_to"))
    tile = lambda x, by: F.floor(F.floor(x * CELLS_PER_DEGREE + by) / TILE).cast("bigint")
    tiles = F.sequence(tile(F.col("x_from"), -1), tile(F.col("x_to"), 1))
    return paired.select("*", F.explode(tiles).alias("tile"))


def with_regions(cells: DataFrame, edges: DataFrame, region: str = "state",
                 keys: list[str] | None = None) -> DataFrame:
    """Add the region to rows that carry a cell (``cx``, ``cy``).

    ``keys`` (all columns by default, cx and cy among them) tell the rows apart.
    Every row stays exactly once: with several matching regions the
    alphabetically first one is taken, without any the region is null.  Whether the
    intervals are broadcast or shuffled is decided at run time, by their size after the
    shuffle that pairs them.
    """
    keys = keys or cells.columns
    px = F.col("cx") / F.lit(float(CELLS_PER_DEGREE))
    keyed = cells.withColumn("tile", F.floor(F.col("cx") / TILE).cast("bigint"))
    hits = keyed.join(
        row_intervals(edges, region).withColumnRenamed("cy", "row").withColumnRenamed("tile", "row_tile"),
        (F.col("cy") == F.col("row")) & (F.col("tile") == F.col("row_tile"))
        & (px >= F.col("x_from")) & (px < F.col("x_to")), "left")
    # The grouping starts with the join keys, so it needs no further shuffle.
    payload = [c for c in cells.columns if c not in keys]
    return (hits.groupBy("cy", "tile", *[c for c in keys if c != "cy"])
            .agg(F.min(region).alias(region), *[F.first(c).alias(c) for c in payload])
            .select(*cells.columns, region))


def cell_regions(points: DataFrame, edges: DataFrame, region: str = "state") -> DataFrame:
    """Region of every distinct cell of a point table with ``cx`` and ``cy``."""
    return with_regions(points.select("cx", "cy").distinct(), edges, region)


def attach_regions(features: DataFrame, edges: DataFrame, region: str = "state",
                   keep_outside: bool = True) -> DataFrame:
    """Region per feature, through its cell.  A cell may hold any share of the
    features, hence the skew-safe join.  Features without a cell are outside, as in
    ``release_stats``, and do not go through the join, where they would meet in one task."""
    # One row per cell, used for the lookup and to find the hot cells.  The filter keeps
    # the count in the lookup's plan, so that both share one shuffle and the features are
    # read only twice, and once more for those without a cell.
    counts = (features.where(F.col("cx").isNotNull() & F.col("cy").isNotNull())
              .groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")))
    lookup = with_regions(counts.where("n > 0").select("cx", "cy"), edges, region)
    if not keep_outside:
        lookup = lookup.where(F.col(region).isNotNull())
    found = skew_join(features, lookup, ["cx", "cy"], hot=hot_among(counts, ["cx", "cy"]))
    if not keep_outside:
        return found
    nowhere = features.where(F.col("cx").isNull() | F.col("cy").isNull())
    return found.unionByName(nowhere.withColumn(region, F.lit(None).cast(lookup.schema[region].dataType)))


def region_or_outside(region: str = "state") -> Column:
    return F.coalesce(F.col(region), F.lit(OUTSIDE))


def with_cell(segments: DataFrame, parts: str = "parts") -> DataFrame:
    """Add the cell of the line centroid."""
    return (segments.withColumn("_c", geo.line_centroid(parts))
            .withColumn("cx", geo.cell(F.col("_c.x"))).withColumn("cy", geo.cell(F.col("_c.y"))).drop("_c"))
