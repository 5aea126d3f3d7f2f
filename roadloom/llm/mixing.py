"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.store import parts, stored

#: Words in a block.
BLOCK_WORDS = 64
#: Slots whose ranks are counted together.
CHUNK_SLOTS = 1 << 16
#: The schedule's points are multiples of the golden ratio modulo 2 ** 42, in whole numbers; the factor is odd, so that none returns.
_ONE = 1 << 42
_STEP = round(_ONE * (5**0.5 - 1) / 2) | 1
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """(key, source, source_size, target, rank) for each source of ``sizes`` (key, source, size).

    Sources in code point order, null last, weigh ``weights``, repeating, and share the sum of all sizes.  A target stops at
    ``most`` times its source's size; what is over is shared again by weight until none is above.  In order of the
    weight at which they are full, source j is full when its limit is no more than its share of what the ones before it leave.
    The windows here see one row per source.
    """
    rows = sizes.groupBy("key", "source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = rows.withColumn("rank", F.row_number().over(by_name)).withColumn("w", weight.cast("decimal(20,0)"))
    everything = Window.partitionBy(F.lit(0))
    full = F.col("source_size").cast("decimal(20,0)") * most
    fill = Window.partitionBy(F.lit(0)).orderBy(full / F.col("w"), "rank")
    before, on = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("full", full).withColumn("all", F.sum("source_size").over(everything).cast("decimal(20,0)"))
    rows = rows.withColumn("left", F.col("all") - F.coalesce(F.sum("full").over(before), F.lit(0))).withColumn("w_on", F.sum("w").over(on))
    rows = rows.withColumn("is_full", F.col("full") * F.col("w_on") <= F.col("w") * F.col("left"))
    kept = F.col("all") - F.coalesce(F.sum(F.when(F.col("is_full"), F.col("full"))).over(everything), F.lit(0))
    rest = F.sum(F.when(~F.col("is_full"), F.col("w"))).over(everything)
    target = F.when(F.col("is_full"), F.col("full").cast("double")).otherwise(kept.cast("double") * F.col("w").cast("double") / rest.cast("double"))
    return rows.select("key", "source", "source_size", target.alias("target"), "rank")


def _share(h: Column, n: int) -> Column:
    """The number of the interval, of ``n`` equal ones, in which a signed 64-bit hash lies; it grows with the hash."""
    return F.least(F.floor((h.cast("double") / F.lit(2.0**64) + 0.5) * n), F.lit(n - 1)).cast("int")


def placed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = 0, keep: DataFrame | None = None) -> DataFrame:
    """Every row with the place of its words in the shuffled sequence of its source: key, source, doc_id, size, first.

    The order is that of a hash of id and text, so that reruns agree; rows that are equal in both are interchangeable.  Sums go by
    intervals of the hash, so that no task orders a whole source.
    """
    n = 8 * parts(docs.sparkSession)
    carried = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if keep is not None else []
    rows = docs.select(
        F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col))).alias("key"),
        F.col(source_col).alias("source"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
        *carried,
    ).withColumn("bin", _share(F.col("h"), n))
    sums = rows.groupBy("key", "bin").agg(F.sum("size").alias("in_bin"))
    base = sums.select("key", "bin", (F.sum("in_bin").over(Window.partitionBy("key").orderBy("bin")) - F.col("in_bin")).alias("base"))
    inner = Window.partitionBy("key", "bin").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("inside", F.sum("size").over(inner) - F.col("size")).join(base, ["key", "bin"])
    return rows.select("key", "source", "doc_id", "size", (F.col("base") + F.col("inside")).alias("first"), *(["row"] if carried else []))


def schedule(goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per slot of the mix: slot, key, turn (the how manieth slot of its source), block, epoch.

    Slot i has the point i * golden ratio modulo 1; the sources' targets, one after another, cut the unit interval, and the point
    falls into one.  A source's slots take its blocks in order, again from the first when all are used.  Slots that would use a
    block a fourth time stay empty.  The join goes by cells of the interval, the ranks by chunks of slots: no task holds a whole source.
    """
    spark = goals.sparkSession
    total, sources = goals.agg(F.sum("target"), F.count("*")).first()
    slots = -(-int(round(total or 0)) // block_words)
    shift = max(1, 42 - max(12, (4 * sources).bit_length()))
    upto = F.sum("target").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = goals.withColumn("hi", F.least(F.floor(upto / F.lit(float(total or 1)) * _ONE), F.lit(_ONE)).cast("long"))
    last = F.when(F.lead("rank").over(Window.orderBy("rank")).isNull(), F.lit(_ONE)).otherwise(F.col("hi"))
    ends = ends.withColumn("hi", last).withColumn("lo", F.lag("hi", 1, 0).over(Window.orderBy("rank")))
    ends = ends.where("hi > lo").select("key", "lo", "hi", F.ceil(F.col("source_size") / block_words).cast("long").alias("blocks"))
    ends = ends.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))))
    i = F.col("id")
    point = F.expr(f"((((id div {1 << 20}) * {_STEP}) % {_ONE}) * {1 << 20} % {_ONE} + (id % {1 << 20}) * {_STEP} % {_ONE}) % {_ONE}")
    points = spark.range(slots).select(i.alias("slot"), point.alias("p")).withColumn("cell", F.shiftright("p", shift))
    found = points.join(ends, "cell").where("lo <= p and p < hi").select("slot", "key", "blocks", F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk"))
    found = stored(found, "slots")
    sums = found.groupBy("key", "chunk").agg(F.count("*").alias("n"))
    base = sums.select("key", "chunk", (F.sum("n").over(Window.partitionBy("key").orderBy("chunk")) - F.col("n")).alias("base"))
    inner = F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot"))
    out = found.withColumn("inner", inner).join(base, ["key", "chunk"]).withColumn("turn", F.col("base") + F.col("inner") - 1)
    out = out.select("slot", "key", "turn", (F.col("turn") % F.col("blocks")).alias("block"), F.expr("turn div blocks").alias("epoch"))
    return out


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), most: int = 3, block_words: int = BLOCK_WORDS, seed: int = 0, with_rows: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, taken, by_epoch; with ``with_rows`` also the row.

    size is the number of words of the whole text (null: 0); taken is how many the mix takes, repeats counted; by_epoch has the
    words of each pass over the source.  A row without words takes part with size 0.  Null ids and sources are values like
    others, repeated rows are rows of their own, clashing column names do no harm, an empty table gives an empty one.
    """
    rows = stored(placed(docs, id_col, text_col, source_col, seed, docs if with_rows else None), "placed")
    goals = stored(targets(rows.select("key", "source", "size"), weights, most), "targets")
    used = schedule(goals, block_words).where(F.col("epoch") < most).groupBy("key", "block").agg(F.count("*").alias("times"))
    low, high = F.expr(f"first div {block_words}"), F.expr(f"(first + size - 1) div {block_words}")
    cut = rows.where("size > 0").select("key", "first", "size", F.explode(F.sequence(low, high)).alias("block"))
    words = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest("first", F.col("block") * block_words)
    sums = [F.sum(F.when(F.col("times") > e, words).otherwise(0)) for e in range(most)]
    taken = cut.join(used, ["key", "block"]).groupBy("key", "first").agg(F.array(*sums).alias("by_epoch"))
    has = F.col("size") > 0
    rows = rows.withColumn("place", F.when(has, F.col("first")))
    out = rows.join(taken.withColumnRenamed("first", "place"), ["key", "place"], "left").join(goals.drop("source", "rank"), "key")
    none = F.array(*[F.lit(0).cast("long")] * most)
    out = out.withColumn("by_epoch", F.coalesce("by_epoch", none))
    total = F.aggregate("by_epoch", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "size", "source", "source_size", "target", total.alias("taken"), "by_epoch", *(["row"] if with_rows else []))


def _first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import re

    for batch in batches:
        out = []
        for text, n in zip(batch.column("_text").to_pylist(), batch.column("_n").to_pylist(), strict=True):
            end = 0
            for _, m in zip(range(n), re.finditer(WORDS, text), strict=False):
                end = m.end()
            out.append(text[:end])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], [*batch.schema.names[:-2], "_text"])


def mixed_rows(docs: DataFrame, text_col="text", chars_col="n_chars", **how) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each pass that takes words of it.  A row of which a pass takes only the
    first words (one per source at most, where the target ends) has these words as its text; ``chars_col`` follows."""
    out = mix(docs, text_col=text_col, with_rows=True, **how)
    out = out.select("row", "size", F.explode("by_epoch").alias("n")).where("n > 0")
    whole = out.where("n >= size").select("row.*")
    cut = out.where("n < size").select("row.*", F.col(f"row.{text_col}").alias("_text"), F.col("n").cast("long").alias("_n"))
    fields = [f for f in cut.schema.fields if f.name != "_n"]
    cut = cut.mapInArrow(_first_words, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
    new = {text_col: F.col("_text")} | ({chars_col: F.char_length("_text").cast(dict(docs.dtypes)[chars_col])} if chars_col in docs.columns else {})
    return whole.union(cut.withColumns(new).select(*docs.columns))
