"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.encoder import encoder


def counted(docs: DataFrame, path: str, text_col="text", *keep: str) -> DataFrame:
    """n_tokens of every row's whole text (null: empty, 0 tokens), beside the columns ``keep``; no special tokens are added.  Repeated
    rows are rows of their own, an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = encoder(path).lengths([t or "" for t in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["n_tokens long"])
    return rows.mapInArrow(run, schema)


def histogram(counts: DataFrame, length_col="n_tokens", limits: Sequence[int] = (), shares: Sequence[float] = ()) -> DataFrame:
    """One row per length that occurs or is asked for: length, docs, tokens, docs_from, tokens_from, docs_to, tokens_to, truncated,
    is_limit, shares.

    docs_from and tokens_from are suffix sums (this length or longer), docs_to and tokens_to prefix sums; truncated is the sum of
    min(length, this length) over all documents, that is what a context of this length keeps.  ``limits`` get a row whether a
    document has that length or not (then docs is 0), so that the same sums answer for them; is_limit marks them.  Of ``shares`` a row
    names those whose quantile it is: the smallest length that at least this share of the documents doesn't exceed (nearest rank).
    Null lengths count as 0, repeated rows each count, repeated limits count once.  An empty table gives only the limits, with sums of 0.
    Rows are combined on the map side; what is summed in one window is one row per length, bounded by the longest text
    and not by the number of documents.
    """
    n = F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("length")
    rows = counts.select(n).groupBy("length").agg(F.count("*").alias("docs"))
    asked = counts.sparkSession.createDataFrame([(int(x), 0) for x in set(limits)], "length long, docs long")
    rows = rows.withColumn("is_limit", F.lit(False)).unionByName(asked.withColumn("is_limit", F.lit(True)))
    rows = rows.groupBy("length").agg(F.sum("docs").alias("docs"), F.max("is_limit").alias("is_limit")).withColumn("tokens", F.col("length") * F.col("docs"))
    up = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(c).over(w).alias(f"{c}_{name}") for name, w in (("from", down), ("to", up)) for c in ("docs", "tokens")]
    out = rows.select("length", "docs", "tokens", *sums, "is_limit")
    out = out.withColumn("truncated", F.col("tokens_to") + F.col("length") * (F.col("docs_from") - F.col("docs")))
    whole = F.col("docs_to") + F.col("docs_from") - F.col("docs")

    def here(share):
        rank = F.greatest(F.ceil(share * whole), F.lit(1))
        return (rank <= F.col("docs_to")) & (rank > F.col("docs_to") - F.col("docs"))

    wanted = F.array(*map(F.lit, map(float, shares))).cast("array<double>")
    sums = [c for c in out.columns if c not in ("is_limit", "truncated")]
    return out.select(*sums, "truncated", "is_limit", F.filter(wanted, here).alias("shares"))


def for_limits(hist: DataFrame) -> DataFrame:
    """One row per context limit of a histogram made for it: limit, docs_over (longer documents), kept (sum of min(length, limit)),
    lost.  All of it stands in the limit's own row."""
    over = F.col("docs_from") - F.col("docs")
    lost = F.col("tokens_from") - F.col("tokens") - F.col("length") * over
    return hist.where("is_limit").select(F.col("length").alias("limit"), over.alias("docs_over"), F.col("truncated").alias("kept"), lost.alias("lost"))


def quantiles(hist: DataFrame) -> DataFrame:
    """One row per share of a histogram made for it: share, length.  Without documents there is none."""
    return hist.select(F.explode("shares").alias("share"), "length")
