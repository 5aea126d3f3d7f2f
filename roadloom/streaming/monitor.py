"""Turn-log monitor: activity per time window from the appended log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.sources.records import TURN_SCHEMA


def read_turn_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(TURN_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    turns = reader.json(path)
    return turns.withColumn("ts", F.to_timestamp("ts"))


def turn_windows(turns: DataFrame, width: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Turns, turns with a failed query, and mean seconds per window.  Works on
    a stream (with the allowed lateness ``late``) and on a table."""
    rows = turns.withWatermark("ts", late) if turns.isStreaming and late else turns
    failed = F.exists("queries", lambda q: ~q["ok"])
    return (rows.groupBy(F.window("ts", width).alias("w"))
            .agg(F.count(F.lit(1)).alias("turns"), F.count_if(failed).alias("turns_with_failure"),
                 F.avg("seconds").alias("mean_seconds"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "turns", "turns_with_failure", "mean_seconds"))
