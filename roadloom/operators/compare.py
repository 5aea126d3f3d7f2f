"""Comparing releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.constants import TOP_DELTAS


def compare_releases(stats: DataFrame, release_a: str, release_b: str, dimension: str = "state") -> DataFrame:
    """Both sides of one dimension in a single pass; a side without rows counts as 0."""
    side = lambda r, c: F.coalesce(F.sum(F.when(F.col("release") == r, F.col(c))), F.lit(0))
    both = stats.where(F.col("release").isin(release_a, release_b)).groupBy(dimension).agg(
        side(release_a, "length_km").cast("double").alias("length_km_a"),
        side(release_a, "segments").cast("bigint").alias("segments_a"),
        side(release_b, "length_km").cast("double").alias("length_km_b"),
        side(release_b, "segments").cast("bigint").alias("segments_b"))
    return (both.where(F.col(dimension).isNotNull())
            .withColumn("delta_km", F.col("length_km_b") - F.col("length_km_a"))
            .withColumn("delta_segments", F.col("segments_b") - F.col("segments_a"))
            .withColumn("pct_change", F.when(F.col("length_km_a") > 0,
                                             F.try_divide(F.lit(100.0) * F.col("delta_km"), F.col("length_km_a"))))
            .orderBy(F.col("delta_km").desc_nulls_last(), dimension))


def gain_loss(comparison: DataFrame) -> DataFrame:
    """Net change, gains and losses of a comparison."""
    d = F.col("delta_km")
    return comparison.agg(F.coalesce(F.sum(d), F.lit(0.0)).alias("net_km"),
                          F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0.0)).alias("gained_km"),
                          F.coalesce(F.sum(F.when(d < 0, d)), F.lit(0.0)).alias("lost_km"))


def top_deltas(comparison: DataFrame, dimension: str = "state", n: int = TOP_DELTAS) -> DataFrame:
    """The n largest changes in either direction, shown by signed change."""
    return (comparison.orderBy(F.abs("delta_km").desc_nulls_last(), dimension).limit(n)
            .orderBy(F.col("delta_km").desc_nulls_last(), dimension))


def scope_groups(scopes: DataFrame) -> DataFrame:
    """release, scope_group, previous: releases may be compared iff they share a
    group, which is named after its first release.  Releases without a complete
    record belong to none.  Linear in the number of releases: no pairs are
    formed, ``previous`` is the last release before with the same scope."""
    keyed = scopes.where(F.col("bbox").isNotNull() & F.col("classes").isNotNull()).select(
        "release", F.to_json("bbox").alias("_bbox"), F.to_json("classes").alias("_classes"))
    same = Window.partitionBy("_bbox", "_classes")
    return keyed.select("release", F.min("release").over(same).alias("scope_group"),
                        F.lag("release").over(same.orderBy("release")).alias("previous"))


def comparable_pairs(scopes: DataFrame) -> DataFrame:
    """Every release next to the last comparable one before it."""
    return scope_groups(scopes).where(F.col("previous").isNotNull()).select(
        F.col("previous").alias("release_a"), F.col("release").alias("release_b"))


def comparability(releases: DataFrame, scopes: DataFrame, anchor: str) -> DataFrame:
    """Whether each release may be compared with ``anchor``, and why not.

    The anchor's record is one row and comes in as a scalar, not as a join.
    """
    record = scopes.select("release", "bbox", "classes")
    base = record.where(F.col("release") == anchor).limit(1)
    rows = (releases.select("release").distinct().join(record, "release", "left")
            .withColumn("anchor", F.lit(anchor))
            .withColumn("_a_bbox", base.select("bbox").scalar())
            .withColumn("_a_classes", base.select("classes").scalar()))
    no_a, no_b = F.col("_a_bbox").isNull(), F.col("bbox").isNull()
    missing = F.concat_ws(", ", F.when(no_a, F.col("anchor")),
                          F.when(no_b & (F.col("release") != F.col("anchor")), F.col("release")))
    text = lambda c: F.array_join(F.transform(F.col(c), lambda v: v.cast("string")), ", ")
    reason = (
        F.when(no_a | no_b, F.concat(F.lit("No scope record for "), missing))
        .when(F.col("_a_bbox") != F.col("bbox"),
              F.concat(F.lit("Different areas: "), text("_a_bbox"), F.lit(" vs "), text("bbox")))
        .when(F.col("_a_classes") != F.col("classes"),
              F.concat(F.lit("Different road classes: "), text("_a_classes"), F.lit(" vs "), text("classes")))
        .otherwise(F.lit("")))
    return rows.select("release", (reason == "").alias("comparable"), reason.alias("reason"))
