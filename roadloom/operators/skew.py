"""Joins and rank statistics that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 64      # a key with more than 1/64 of all rows is hot: at most 64 keys can be
SALTS = 64


def hot_keys(df: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``1/share`` of the rows with a key.

    Fewer than ``share`` keys can qualify, whatever the size of the table, so
    the result may be broadcast.  Counting is combined on the map side.
    """
    counts = df.where(_present(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return hot_among(counts, keys, share)


def hot_among(counts: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """The same from counts ``n`` that are already there."""
    total = counts.agg(F.sum("n"))
    return counts.where(F.col("n") * share > total.scalar()).select(*keys)


def skew_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner",
              hot: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """Equi join of a large, possibly skewed ``rows`` with ``lookup``.

    Rows of hot keys are spread over ``salts`` partitions and only the lookup
    rows of those keys are copied; all other keys are joined as usual.  The
    result is exactly that of a plain join.  ``how`` is inner, left, left_semi
    or left_anti.
    """
    hot = hot_keys(rows, keys) if hot is None else hot
    flagged = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    # The partition id keeps identical copies apart and, unlike a random number,
    # gives the same salt when a lost task is run again.
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(F.spark_partition_id(), *_hashable(rows)), F.lit(salts))
                    ).otherwise(F.lit(0))
    left = rows.join(flagged, keys, "left").withColumn("_salt", spread.cast("int")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.join(flagged, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    joined = left.join(right, [*keys, "_salt"], how).drop("_salt")
    tail = [] if how in ("left_semi", "left_anti") else [c for c in lookup.columns if c not in keys]
    return joined.select(*rows.columns, *tail)


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def _present(keys):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float],
              partitions: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: columns ``by`` + ``p`` + ``quantile``.

    Works on (group, value) counts, combined on the map side, range-partitioned
    by value.  Ranks come from per-partition totals, and only the partitions
    that hold a wanted rank are looked at again, so no task ever sees more than
    one range partition, however large a group is.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
              .repartitionByRange(partitions, *by, "_v")
              .withColumn("_part", F.spark_partition_id())
              .persist())
    # One row per group and partition: bounded by the number of partitions.
    totals = counts.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"))
    order = Window.partitionBy(*by).orderBy("_part")
    starts = totals.withColumn("_end", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    starts = starts.withColumn("_start", F.col("_end") - F.col("_size"))
    whole = Window.partitionBy(*by)
    ranks = starts.withColumn("_all", F.sum("_size").over(whole))
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("p"), ((F.col("_all") - 1) * float(p)).alias("at"))
                       for p in probabilities])
    ranks = (ranks.select("*", F.explode(wanted).alias("_w"))
             .select("*", "_w.p", F.col("_w.at").alias("_at"))
             .select("*", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank"))
             .where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end")))
             .select(*by, "_part", "p", "_at", "_rank", "_start").distinct())
    inside = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    needed = ranks.select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col("_part").alias("_k_part"),
                          "_start").distinct()
    same_part = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by] + [F.col("_part") == F.col("_k_part")]
    cumulated = (counts.join(needed, _all(same_part)).select(*by, "_part", "_v", "_n", "_start")
                 .withColumn("_to", F.sum("_n").over(inside) + F.col("_start"))
                 .withColumn("_from", F.col("_to") - F.col("_n"))
                 .select(*by, "_part", "_v", "_from", "_to"))
    spots = ranks.select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col("_part").alias("_k_part"),
                         "p", "_at", "_rank")
    found = cumulated.join(spots, _all([*same_part, F.col("_rank") >= F.col("_from"),
                                        F.col("_rank") < F.col("_to")]))
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    return (found.groupBy(*by, "p", "_at").agg(low.cast("double").alias("_lo"), high.cast("double").alias("_hi"))
            .select(*by, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at")))
                    .alias("quantile")))


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
