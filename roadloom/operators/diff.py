"""Feature-level differences between two releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH_CHANGE_KM = 0.001


def id_status(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per feature id: which side has it, and its length on each side.

    Both sides are stacked and grouped once, combined on the map side, so it
    does not matter how many copies of an id there are.  With several rows per
    id the smallest length counts, which makes the result deterministic.
    """
    def rows(df, in_a):
        km = F.col("length_km").cast("double")
        none = F.lit(None).cast("double")
        return df.select("id", F.lit(in_a).alias("in_a"), F.lit(not in_a).alias("in_b"),
                         (km if in_a else none).alias("km_a"), (none if in_a else km).alias("km_b"))

    return (rows(a, True).unionByName(rows(b, False)).where(F.col("id").isNotNull()).groupBy("id")
            .agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"),
                 F.min("km_a").alias("km_a"), F.min("km_b").alias("km_b"))
            .withColumn("status", F.when(F.col("in_a") & F.col("in_b"), "kept")
                        .when(F.col("in_b"), "added").otherwise("removed")))


def churn(a: DataFrame, b: DataFrame) -> DataFrame:
    """Kept, added and removed ids, their kilometres, and length changes of kept ids."""
    s = id_status(a, b)
    is_ = lambda v: F.col("status") == v
    added = F.coalesce(F.sum(F.when(is_("added"), F.col("km_b"))), F.lit(0.0))
    removed = F.coalesce(F.sum(F.when(is_("removed"), F.col("km_a"))), F.lit(0.0))
    changed = is_("kept") & (F.abs(F.col("km_b") - F.col("km_a")) > LENGTH_CHANGE_KM)
    return s.agg(F.count_if(is_("kept")).alias("kept"), F.count_if(is_("added")).alias("added"),
                 F.count_if(is_("removed")).alias("removed"),
                 added.alias("added_km"), removed.alias("removed_km"), (added - removed).alias("net_km"),
                 F.count_if(changed).alias("changed_length"))


def length_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Kept ids whose length differs by more than a metre."""
    delta = F.col("km_b") - F.col("km_a")
    return (id_status(a, b).where(F.col("status") == "kept").where(F.abs(delta) > LENGTH_CHANGE_KM)
            .select("id", "km_a", "km_b", delta.alias("delta_km")))


def added_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``b`` whose id is not in ``a``.  Each side is read once; ids hardly repeat, and a
    repeated one is split by adaptive execution, which needs the shuffles right below the join."""
    return b.join(a.select("id"), "id", "left_anti").select(*b.columns)


def removed_features(a: DataFrame, b: DataFrame) -> DataFrame:
    return added_features(b, a)


def kept_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``b`` whose id is in ``a`` as well."""
    return b.join(a.select("id"), "id", "left_semi").select(*b.columns)


def id_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids with the set they belong to."""
    return id_status(a, b).select("id", "status")


def one_per_id(df: DataFrame) -> DataFrame:
    """One row per id: the smallest one, column by column from the left."""
    rest = [c for c in df.columns if c != "id"]
    return (df.groupBy("id").agg(F.min(F.struct(*rest)).alias("_r"))
            .select("id", *[F.col(f"_r.{c}").alias(c) for c in rest]))


def path_rows(features: DataFrame, parts: str = "parts") -> DataFrame:
    """One row per path of a line feature; features without paths have none."""
    others = [c for c in features.columns if c != parts]
    return features.select(*others, F.posexplode(parts).alias("path_no", "path"))
