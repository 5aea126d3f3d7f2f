"""The turn log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.operators.skew import quantiles


def flatten_turns(turns: DataFrame) -> DataFrame:
    """One flat row per turn with its number of queries and of failed ones."""
    return turns.select(
        "ts", "provider", "model", "seconds", F.coalesce(F.size("queries"), F.lit(0)).alias("queries"),
        F.coalesce(F.size(F.filter("queries", lambda q: ~q["ok"])), F.lit(0)).alias("failed_queries"),
        "question", "answer")


def log_summary(flat: DataFrame) -> DataFrame:
    """Turns, median seconds, and turns with at least one failed query."""
    counts = flat.agg(F.count(F.lit(1)).alias("turns"),
                      F.count_if(F.col("failed_queries") > 0).alias("turns_with_failure"))
    one = flat.select(F.lit(1).alias("_one"), "seconds")
    median = quantiles(one, ["_one"], "seconds", [0.5]).select(F.max("quantile")).scalar()
    return counts.select("turns", median.alias("median_seconds"), "turns_with_failure")
