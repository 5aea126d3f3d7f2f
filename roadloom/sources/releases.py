"""Release statistics and scope records on disk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.constants import OUTSIDE, SCOPE_TEXTS
from roadloom.functions.dates import release_date
from roadloom.operators.stats import in_report_order

STATS_SCHEMA = ("release string, state string, class string, segments bigint, length_km double, "
                "mean_segment_m double, pct_named double")
SCOPE_SCHEMA = ("release string, bbox array<double>, classes array<string>, state_attribution string, "
                "length string, map_geometry string, fetched_at string, source string, license string, "
                "license_url string, attribution string")


@dataclass(frozen=True)
class ReleaseSet:
    stats: DataFrame
    releases: DataFrame     # release, release_date and the scope record, if any


def write_stats(stats: DataFrame, path: str) -> None:
    """A CSV folder (``stats_<release>.csv``), its part files in report order."""
    in_report_order(stats).write.mode("overwrite").option("header", True).csv(path)


def load_stats(spark: SparkSession, directory: str) -> DataFrame:
    """All ``stats_*.csv`` of a directory as one table, without the rows outside
    the country.  Empty files give no rows."""
    rows = spark.read.schema(STATS_SCHEMA).option("header", True).csv(f"{directory}/stats_*.csv")
    return rows.where(F.col("state") != OUTSIDE).withColumn("release_date", release_date("release"))


def scope_record(spark: SparkSession, release: str, bbox, classes, **texts) -> DataFrame:
    """The record of what a release extract covers."""
    row = {"release": release, "bbox": [round(float(v), 4) for v in bbox], "classes": sorted(classes),
           **SCOPE_TEXTS, **texts}
    df = spark.createDataFrame([row], SCOPE_SCHEMA)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return df.withColumn("fetched_at", F.coalesce("fetched_at", now))


def write_scopes(scopes: DataFrame, directory: str) -> None:
    """One JSON folder per release below ``directory/scopes``; a release that is fetched again replaces its record."""
    (scopes.withColumn("for_release", F.col("release")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("for_release").json(f"{directory}/scopes"))


def load_scopes(spark: SparkSession, path: str) -> DataFrame:
    """Scope records; unreadable JSON gives no record."""
    rows = (spark.read.schema(SCOPE_SCHEMA + ", _bad string").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(path))
    return rows.where(F.col("_bad").isNull() & F.col("release").isNotNull()).drop("_bad")


def with_scopes(stats: DataFrame, scopes: DataFrame) -> DataFrame:
    """Releases with their scope record, null when there is none."""
    return (stats.select("release").distinct().withColumn("release_date", release_date("release"))
            .join(scopes, "release", "left"))


def load_releases(spark: SparkSession, directory: str, scopes_path: str | None = None) -> ReleaseSet:
    stats = load_stats(spark, directory)
    return ReleaseSet(stats, with_scopes(stats, load_scopes(spark, scopes_path or f"{directory}/scope*")))


def latest(df: DataFrame) -> DataFrame:
    """Rows of the newest release present; the release id is a scalar subquery,
    which also prunes partitions when ``release`` is one."""
    return df.where(F.col("release") == df.agg(F.max("release")).scalar())


def register_latest(road_stats: DataFrame, roads: DataFrame | None = None, places: DataFrame | None = None) -> None:
    """Views road_stats, roads and places of the newest release that has statistics."""
    newest = road_stats.agg(F.max("release")).scalar()
    for name, df in (("road_stats", road_stats), ("roads", roads), ("places", places)):
        if df is not None:
            df.where(F.col("release") == newest).createOrReplaceTempView(name)
