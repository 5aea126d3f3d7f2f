"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import bpe, dedup, jaccard, langid, mixing
from roadloom.llm.store import shared_folder, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go; all others stay as they are."""
    found = langid.identify(docs, langid.fit(docs), keep_rows=True)
    return found.where(F.col("found.lang_pred") != langid.UNKNOWN).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the one with the most code points stays, then the smallest id; of rows that
    agree in every column, one.  A row is known by a hash of all its columns, whichever way it is read."""
    tag = F.xxhash64(*docs.columns)
    found = dedup.copies(docs, tag=tag).where("kept").select(F.col("row_tag").alias("_row"))
    rows = docs.withColumn("_row", tag).join(found, "_row", "left_semi")
    return rows.dropDuplicates(["_row", "doc_id"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share at least 0.8 of their five-word shingles, the one with the smallest id stays (one
    without id only if none has one); documents without words stay.  A row is known by a hash of all its columns, so that rows which
    only share an id are documents of their own; rows that agree in every column stay or go together."""
    tagged = docs.withColumn("_row", F.xxhash64(*docs.columns))
    found = jaccard.components_of(tagged, id_col="_row").where("component_id <> doc_id")
    linked = stored(found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).distinct(), "linked")
    members = linked.unionByName(linked.select(F.col("_group").alias("_row"), "_group").distinct())
    known = tagged.select("_row", "doc_id").join(members, "_row")
    first = known.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    gone = known.join(first, "_group").where(F.col("_row") != F.col("first._row")).select("_row").distinct()
    return tagged.join(gone, "_row", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares: a row for each time that a document is taken."""
    return mixing.mixed_rows(docs)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, as digests beside their number."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_jaccard", near_duplicates), ("source_mix", source_mix), ("bpe", bpe_ids)]
#: Language identification, the mix's order and the token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
