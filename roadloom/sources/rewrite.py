"""Verified rewrite of a feature file into the slim form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.sources.geojson import parse_features, read_lines, road_lines, write_features

#: Primes below 2 ** 31 and the base of the polynomial: products stay within 64 bits.
_PRIMES, _BASE = (2147483647, 2147483629), 1_000_003
_RUN = "part int, at int, place string, n long, mark_1 long, mark_2 long"


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, id) rows in order to one row for each stretch of a place: the number of ids and the polynomial whose
    coefficients they are, modulo two primes."""
    part, at, place, n, marks = TaskContext.get().partitionId(), 0, None, 0, [0, 0]

    def row():
        return pa.RecordBatch.from_pylist([{"part": part, "at": at, "place": place, "n": n, "mark_1": marks[0], "mark_2": marks[1]}],
                                          schema=pa.schema([("part", pa.int32()), ("at", pa.int32()), ("place", pa.string()), ("n", pa.int64()), ("mark_1", pa.int64()), ("mark_2", pa.int64())]))

    for batch in batches:
        places, hashes = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
        cuts = [i for i in range(1, len(places)) if places[i] != places[i - 1]]
        for lo, hi in zip([0, *cuts], [*cuts, len(places)], strict=True):
            if lo == hi:
                continue
            if n and places[lo] != place:
                yield row()
                at, n, marks = at + 1, 0, [0, 0]
            place, n = places[lo], n + hi - lo
            for k, p in enumerate(_PRIMES):
                power = np.ones(hi - lo, np.int64)
                step = _BASE % p
                for bit in range((hi - lo).bit_length()):           # _BASE ** (hi - lo - 1 - i) by squaring
                    power = np.where((np.arange(hi - lo)[::-1] >> bit) & 1, power * step % p, power)
                    step = step * step % p
                own = int(((hashes[lo:hi] % np.uint64(p)).astype(np.int64) * power % p).sum())
                marks[k] = (marks[k] * pow(_BASE, hi - lo, p) + own) % p
    if n:
        yield row()


def sequence(df: DataFrame, id_col: str = "id", place: str | None = None) -> tuple[int, int, int]:
    """The number of ids and a fingerprint of their order.

    The fingerprint is associative: stretches are worked out where the rows are and put one after another, by task or, with a
    ``place`` column, by the order of places.  What reaches the driver is a row for each task and place.
    Two orders agree by chance once in some 2 ** 61.
    """
    rows = df.select(F.col(place).alias("place") if place else F.lit("").alias("place"), F.xxhash64(F.col(id_col)).alias("h"))
    total, marks = 0, [0, 0]
    for r in sorted(rows.mapInArrow(_marks, _RUN).collect(), key=lambda r: (r["place"], r["part"], r["at"])):
        total += r["n"]
        marks = [(m * pow(_BASE, r["n"], p) + r[c]) % p for m, p, c in zip(marks, _PRIMES, ("mark_1", "mark_2"), strict=True)]
    return total, *marks


def written_order(spark: SparkSession, path: str) -> DataFrame:
    """(place, id) of the features in lines files; the names of the part files follow the tasks that wrote them."""
    meta = F.concat(F.col("_metadata.file_path"), F.lit(" "), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
    return spark.read.text(path).select(meta.alias("place"), F.get_json_object("value", "$.id").alias("id"))


class RewriteError(RuntimeError):
    pass


def verify(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: features, ids whose number of copies differs, km on both sides, ok.

    Lengths are rounded to 4 decimals on the way, so the totals may differ by
    5e-5 per feature.  Both sides are stacked and counted per id, combined on
    the map side.
    """
    def side(df, sign):
        return df.select("id", F.lit(sign).alias("n"), F.col("length_km").cast("double").alias("km"))

    per_id = side(before, 1).unionByName(side(after, -1)).groupBy("id").agg(
        F.sum("n").alias("balance"), F.count_if(F.col("n") == 1).alias("n"),
        F.sum(F.when(F.col("n") == 1, F.col("km"))).alias("km_before"),
        F.sum(F.when(F.col("n") == -1, F.col("km"))).alias("km_after"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    totals = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("features"), F.count_if(F.col("balance") != 0).alias("different_ids"),
        zero("km_before").alias("km_before"), zero("km_after").alias("km_after"))
    drift = F.abs(F.col("km_before") - F.col("km_after"))
    return totals.withColumn("ok", (F.col("different_ids") == 0) & (drift <= 5e-5 * F.col("features") + 1e-6))


def road_fields(features: DataFrame) -> DataFrame:
    """The fields of a road feature, from its property map."""
    p = F.col("properties")
    return features.select(
        F.col("feature_id").alias("id"), p["class"].alias("class"), p["state"].alias("state"),
        p["length_km"].try_cast("double").alias("length_km"), p["name"].alias("name"),
        F.coalesce(p["is_named"].try_cast("boolean"), F.lit(True)).alias("is_named"), "geometry")


def compact(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite ``source`` as slim features at ``target`` and check the result by
    reading it back.  Raises RewriteError when ids, their order or kilometres
    differ.  The source is never touched; dropping it is up to the caller."""
    before = road_fields(parse_features(read_lines(spark, source)))
    write_features(road_lines(before), target)
    report = verify(before, road_fields(parse_features(read_lines(spark, target, "lines"))))
    found = report.first()
    if not found["ok"]:
        raise RewriteError(f"verification failed for {source}; the original stays in use")
    if sequence(before) != sequence(written_order(spark, target), place="place"):
        raise RewriteError(f"the features of {source} have come out of order; the original stays in use")
    return spark.createDataFrame([found], report.schema)
