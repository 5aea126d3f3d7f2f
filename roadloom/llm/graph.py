"""Connected components of an edge list, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest node it is connected with.

    Every round hangs each node under the smallest node it sees, from both sides, until the edges are stars; the number
    of rounds follows the logarithm of the longest path.  A round writes its edges to the shared folder.  Nothing but
    counts reaches the driver.  An empty table gives an empty table; loops and repeated edges change nothing.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_star(e):
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(small.union(low.toDF("a", "b")).where("a <> b").distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())


def _is_star(e: DataFrame) -> bool:
    """Every node hangs under one root, and no root hangs under another."""
    up = e.groupBy("a").agg(F.count("*").alias("n"))
    return up.where("n > 1").isEmpty() and e.select("b").join(up.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
