"""Sharding over fixed virtual slots: records hash into slots, a stored and versioned map gives each slot its shard."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.llm.store import stored

#: Virtual slots; fixed for the life of a corpus, whatever the number of shards.  All tables by slot have so many rows.
SLOTS = 4096
RECORD = ("doc_id", "size", "text_crc32")


def _record(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]


def _slot(copy: Column) -> Column:
    """Slot of the ``copy``-th of the rows that agree in id, size and checksum: they are dealt round, from a place their hash names."""
    return F.pmod(F.xxhash64(*RECORD) + copy, F.lit(SLOTS)).cast("int")


def records(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, copies): what of ``docs`` lies in which slot; size is UTF-8 bytes plus one.

    Rows that agree in id, size and checksum are counted before the shuffle and dealt round the slots from the one their hash
    names, so that a repeated row, however frequent, is spread.  Null texts are empty, null ids count as equal, other columns are
    not looked at, and an empty table gives an empty one.
    """
    each = docs.select(*_record(docs, id_col, text_col)).groupBy(*RECORD).agg(F.count("*").alias("n"))
    dealt = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(SLOTS)) - 1)).alias("j"))
    return dealt.select(*RECORD, _slot(F.col("j")).alias("virtual_slot"), F.expr(f"(n - j + {SLOTS - 1}) div {SLOTS}").alias("copies"))


def loads(found: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows) of the slots that hold something."""
    return found.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))


def first_map(spark: SparkSession, shards: int) -> DataFrame:
    """(virtual_slot, shard) before anything is known of the records: slots in turn."""
    return spark.range(SLOTS).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def _edited(slot_map: DataFrame, load: DataFrame, shards: int, takers: list[int]) -> DataFrame:
    """Every shard keeps its largest slots up to an equal share of the bytes; what is over goes, largest first, to the
    emptiest of ``takers``.  Slots larger than a share fill a shard each, and the others share what is left.  The map has SLOTS rows,
    so its windows and its one array are bounded by that constant."""
    rows = slot_map.join(load.select("virtual_slot", "bytes"), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))
    by_size = Window.partitionBy(F.lit(0)).orderBy(F.desc("bytes"), "virtual_slot")
    larger = F.row_number().over(by_size) - 1
    left = F.sum("bytes").over(by_size.rowsBetween(Window.currentRow, Window.unboundedFollowing)) / F.when(larger < shards, F.lit(shards) - larger)
    rows = rows.withColumn("left", left)
    share = F.min(F.when(F.col("bytes") <= F.col("left"), F.col("left"))).over(Window.partitionBy(F.lit(0)))
    inside = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    over = F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)) > share
    rows = rows.withColumn("over", over & (F.row_number().over(inside) > 1))
    state = "struct<held:array<bigint>,to:array<int>>"
    pool = F.sort_array(F.collect_list(F.when(F.col("over"), F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))))
    held = [F.coalesce(F.sum(F.when((F.col("shard") == s) & ~F.col("over"), F.col("bytes"))), F.lit(0).cast("long")) for s in takers]
    start = F.struct(F.array(*held).alias("held"), F.array().cast("array<int>").alias("to")).cast(state)

    def deal(done: Column, slot: Column) -> Column:
        to = (F.array_position(done["held"], F.array_min(done["held"])) - 1).cast("int")
        more = F.transform(done["held"], lambda h, i: F.when(i == to, h - slot["less"]).otherwise(h))
        return F.struct(more.alias("held"), F.concat(done["to"], F.array(to)).alias("to")).cast(state)

    dealt = rows.agg(pool.alias("pool"), start.alias("start")).select("pool", F.aggregate("pool", F.col("start"), deal)["to"].alias("to"))
    moved = dealt.select(F.explode(F.arrays_zip("pool", "to")).alias("m")).select(F.col("m.pool.virtual_slot").alias("virtual_slot"), F.element_at(F.array(*map(F.lit, takers)), F.col("m.to") + 1).alias("shard"))
    return rows.where(~F.col("over")).select("virtual_slot", "shard").union(moved)


def rebalanced(slot_map: DataFrame, load: DataFrame, shards: int) -> DataFrame:
    """The map edited so that the shards hold nearly equal bytes: only slots of shards above an equal share move."""
    return _edited(slot_map, load, shards, list(range(shards)))


def grown(slot_map: DataFrame, load: DataFrame, shards: int) -> DataFrame:
    """The map of ``shards`` shards edited for one more: slots move into the new shard only."""
    return _edited(slot_map, load, shards + 1, [shards])


def save(slot_map: DataFrame, path: str) -> int:
    """Store as the next version under ``path``; versions are never changed.  A version that another writer has stored meanwhile
    raises an error."""
    version = (latest(slot_map.sparkSession, path) + 1) if exists(slot_map.sparkSession, path) else 0
    slot_map.coalesce(1).write.parquet(f"{path}/version={version}")
    return version


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def latest(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).agg(F.max("version")).first()[0]


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard, map_version) of one version, the latest by default."""
    number = latest(spark, path) if version is None else version
    return spark.read.parquet(f"{path}/version={number}").select("virtual_slot", "shard", F.lit(number).alias("map_version"))


def assigned(found: DataFrame, slot_map: DataFrame) -> DataFrame:
    """One row for each record of ``found`` (as ``records`` gives them): doc_id, size, text_crc32, shard, slot, virtual_slot,
    map_version; slot numbers the records of a shard from 0 without gaps.

    A virtual slot knows how many records the slots before it in its shard hold, and numbers its own in order of id, size and
    checksum; so no task orders a whole shard.  The map has SLOTS rows and is broadcast.
    """
    counts = slot_map.join(loads(found), "virtual_slot", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("virtual_slot", "shard", "map_version", F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long")).alias("first"))
    inside = Window.partitionBy("virtual_slot").orderBy(*RECORD).rowsBetween(Window.unboundedPreceding, 0)
    rows = found.withColumn("upto", F.sum("copies").over(inside)).join(F.broadcast(places), "virtual_slot")
    rows = rows.select("*", F.explode(F.sequence(F.col("upto") - F.col("copies"), F.col("upto") - 1)).alias("i"))
    return rows.select(*RECORD, "shard", (F.col("first") + F.col("i")).alias("slot"), "virtual_slot", "map_version")


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, id_col="doc_id", text_col="text") -> None:
    """Write the rows of ``docs``, every column as it is, to ``path``/shard=N.

    Equal records are numbered within each input partition first and the partitions' numbers put end to end, so that a repeated row
    is dealt round the slots as in ``records`` without meeting in one task.
    """
    spark = docs.sparkSession
    own = F.struct(*_record(docs, id_col, text_col)).alias("_r")
    tagged = stored(docs.select(own, F.spark_partition_id().alias("_p"), F.struct(*[F.col(c) for c in docs.columns]).alias("_row")), "shard-rows")
    counts = tagged.groupBy("_r", "_p").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("_r").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_r", "_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0).cast("long")).alias("_from"))
    numbered = tagged.withColumn("_i", F.row_number().over(Window.partitionBy("_r", "_p").orderBy(F.lit(0)))).join(starts, ["_r", "_p"])
    slots = numbered.select("_row", (F.col("_from") + F.col("_i") - 1).alias("_copy"), "_r.*").withColumn("virtual_slot", _slot(F.col("_copy")))
    home = slots.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    home.repartition(parts, "shard", F.col("virtual_slot") % parts).select("_row.*", "shard").write.partitionBy("shard").parquet(path)
