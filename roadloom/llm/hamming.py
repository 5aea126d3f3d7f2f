"""Exact top-k search among binary codes by incremental multi-index hashing."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.store import stored

#: The widest segment, in bits.  A segment has about log2(number of codes) bits, so that a probed bucket holds about one code.
WIDEST = 16


def sign_code(vector: Column, dims: int) -> Column:
    """The signs of a vector, 1 from 0 on, as array<long> of 64 bits each; null for null vectors, wrong lengths, nulls and NaN inside."""
    bit = lambda i: F.when(vector[i] >= 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    word = lambda w: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(bit(i), i % 64) for i in range(w, min(w + 64, dims))])
    whole = (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.when(whole, F.array(*[word(w) for w in range(0, dims, 64)]))


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _cuts(dims: int, width: int) -> list[tuple[int, int, int]]:
    """(word, shift, bits) of each segment; none crosses a word."""
    words = [(w // 64, min(64, dims - w)) for w in range(0, dims, 64)]
    return [(w, at, min(width, bits - at)) for w, bits in words for at in range(0, bits, width)]


def _segments(code: Column, cuts: list[tuple[int, int, int]]) -> Column:
    part = lambda i, w, at, bits: F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned(code[w], at).bitwiseAND(F.lit((1 << bits) - 1)).alias("value"))
    return F.explode(F.array(*[part(i, *c) for i, c in enumerate(cuts)]))


def top_k(rows: DataFrame, queries: DataFrame, dims: int, k: int = 10, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(query_id, rank, neighbor_id, distance): for each query its ``k`` nearest other rows by Hamming distance of the signs, ties
    by id; fewer only if the table has fewer.  Rows and queries without id or valid vector take no part; repeated
    rows with the same id are one, and a row is never its own neighbour.  Other columns are not looked at.

    Equal codes are searched once: of each code only the k + 1 smallest ids can be among the k nearest, so a code that a third of
    all rows share is no hot key.  A round probes the values at exactly radius r in each of the m segments, verifies the full
    distance of what it meets, and keeps the best.  Codes within m * (r + 1) - 1 have met by then; a query is done when its last
    wanted distance is covered by that.  There are at most WIDEST + 1 rounds, each written to the shared folder.
    """
    code = sign_code(F.col(vector_col), dims)
    coded = lambda df: df.select(F.col(id_col).cast("long").alias("id"), code.alias("code")).where("id is not null and code is not null").distinct()
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    ids = coded(rows).withColumn("r", rank).where(F.col("r") <= k + 1)
    codes = ids.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    codes = stored(codes.select(F.monotonically_increasing_id().alias("cid"), "code", "ids"), "codes")
    width = max(4, min(WIDEST, codes.count().bit_length()))
    cuts = _cuts(dims, width)
    index = stored(codes.select("cid", _segments(F.col("code"), cuts).alias("s")).select("s.*", "cid"), "index")
    asked = stored(coded(queries).withColumnRenamed("id", "query_id"), "asked")
    wanted = stored(asked.select("code").distinct().select(F.monotonically_increasing_id().alias("qid"), F.col("code").alias("q")), "wanted")
    active, best, done = wanted, None, []
    for r in range(width + 1):
        masks = F.expr(f"filter(sequence(0L, {(1 << width) - 1}L), x -> bit_count(x) = {r})") if r > 3 else F.array(*[F.lit(sum(1 << b for b in c)).cast("long") for c in combinations(range(width), r)])
        probes = active.select("qid", _segments(F.col("q"), cuts).alias("s")).select("qid", "s.seg", F.col("s.value").alias("v"), F.explode(masks).alias("mask"))
        probes = probes.select("qid", "seg", F.col("v").bitwiseXOR(F.col("mask")).alias("value"))
        # Many probes come of few queries: neither side is small enough to be sent to all.
        pairs = probes.hint("merge").join(index, ["seg", "value"]).select("qid", "cid").distinct()
        met = pairs.join(codes, "cid").join(wanted, "qid").select("qid", "cid", F.col("ids")[0].alias("first"), F.size("ids").alias("n"), _distance(F.col("q"), F.col("code")).alias("d"))
        if best is not None:
            met = met.union(best).dropDuplicates(["qid", "cid"])
        near = Window.partitionBy("qid").orderBy("d", "first")
        met = stored(met.withColumn("at", F.row_number().over(near)).where(F.col("at") <= k + 1).drop("at"), f"round{r}")
        covered = len(cuts) * (r + 1) - 1
        sure = met.where(F.col("d") <= covered).groupBy("qid").agg(F.sum("n").alias("c"))
        full = stored(sure.where(F.col("c") >= k + 1).select("qid") if r < width else met.select("qid").distinct(), "full")
        done.append(met.join(full, "qid", "left_semi"))
        best = met.join(full, "qid", "left_anti")
        active = stored(active.join(full, "qid", "left_anti"), "active")
        if active.isEmpty():
            break
    found = reduce(DataFrame.union, done).join(codes, "cid").join(wanted, "qid").select(F.col("q").alias("code"), "d", F.explode("ids").alias("neighbor_id"))
    found = asked.join(found, "code").where("neighbor_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "neighbor_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "neighbor_id", F.col("d").cast("long").alias("distance"))
