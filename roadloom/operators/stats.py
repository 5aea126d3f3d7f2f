"""Release statistics and simple totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.constants import MINOR_CLASSES, OUTSIDE
from roadloom.operators.cells import region_or_outside, with_regions


def release_stats(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """Segments, kilometres, mean length and share of named segments by
    (release, state, class).

    ``segments``: release, class, is_named, length_km, cx, cy.  Segments are
    reduced to one row per cell and class before the region lookup, combined on
    the map side, so neither the lookup nor the final grouping depends on how
    many segments a cell or a state holds.
    """
    per_cell = segments.groupBy("release", "class", "cx", "cy").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("length_km").alias("km"),
        F.count("length_km").alias("n_km"),
        F.count_if(F.col("is_named")).alias("named"),
        F.count("is_named").alias("n_flag"))
    km = F.sum("km")
    return (with_regions(per_cell, edges, keys=["release", "class", "cx", "cy"])
            .groupBy("release", region_or_outside().alias("state"), "class")
            .agg(F.sum("n").alias("segments"),
                 F.round(km, 2).alias("length_km"),
                 F.round(F.try_divide(km, F.sum("n_km")) * 1000, 1).alias("mean_segment_m"),
                 F.round(F.try_divide(F.lit(100.0) * F.sum("named"), F.sum("n_flag")), 1).alias("pct_named")))


def in_report_order(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.col("state").asc_nulls_last(), F.col("length_km").desc_nulls_last(), "class")


def national_km(stats: DataFrame) -> DataFrame:
    """Kilometres per release without the rows outside the country; 0 if there are none."""
    inside = F.when(F.col("state") != OUTSIDE, F.col("length_km"))
    return stats.groupBy("release").agg(F.coalesce(F.sum(inside), F.lit(0.0)).alias("km"))


def inside_only(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("state") != OUTSIDE)


def headline(stats: DataFrame) -> DataFrame:
    """Key figures per release; the named share is weighted by length."""
    weighted = F.sum(F.col("pct_named") * F.col("length_km"))
    return stats.groupBy("release").agg(
        F.sum("length_km").alias("total_km"),
        F.sum("segments").alias("segments"),
        F.coalesce(F.try_divide(weighted, F.sum("length_km")), F.lit(0.0)).alias("pct_named"),
        F.count_distinct("state").alias("states"),
        F.count_distinct("class").alias("classes"))


def ranking(stats: DataFrame, by: str = "state") -> DataFrame:
    """Kilometres by one dimension and release, largest first."""
    return (stats.groupBy("release", by).agg(F.sum("length_km").alias("length_km"))
            .orderBy("release", F.col("length_km").desc_nulls_last(), by))


def classes_covered(stats: DataFrame, scopes: DataFrame) -> DataFrame:
    """The classes of a release: from its scope record, else those present."""
    present = stats.groupBy("release").agg(F.array_sort(F.collect_set("class")).alias("_present"))
    recorded = scopes.select("release", F.col("classes").alias("_recorded"))
    minor = F.array(*[F.lit(c) for c in MINOR_CLASSES])
    classes = F.when(F.size("_recorded") > 0, F.col("_recorded")).otherwise(F.col("_present"))
    return (present.join(recorded, "release", "left")
            .select("release", classes.alias("classes"))
            .withColumn("full_drivable", F.size(F.array_except(minor, F.col("classes"))) == 0))


def headline_delta(stats: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each release against the latest earlier one with the same scope.

    One row per release is left when the window over equal scopes runs, so no
    pairs of releases are formed and the statistics are read once.
    """
    scope = scopes.select("release", F.to_json("bbox").alias("_bbox"), F.to_json("classes").alias("_classes"))
    now = headline(stats).join(scope, "release", "left")
    same = Window.partitionBy("_bbox", "_classes").orderBy("release")
    before = lambda c: F.when(F.col("_bbox").isNotNull(), F.lag(c).over(same))
    return (now.withColumn("previous", before("release")).withColumn("previous_km", before("total_km"))
            .select("release", "total_km", "segments", "pct_named", "previous", "previous_km",
                    (F.col("total_km") - F.col("previous_km")).alias("delta_km"),
                    F.try_divide(F.lit(100.0) * (F.col("total_km") - F.col("previous_km")), F.col("previous_km"))
                    .alias("delta_pct")))


def named_total(df: DataFrame, condition: Column | None, **aggregates: Column) -> DataFrame:
    """One row of totals under a filter."""
    rows = df if condition is None else df.where(condition)
    return rows.agg(*[a.alias(name) for name, a in aggregates.items()])
