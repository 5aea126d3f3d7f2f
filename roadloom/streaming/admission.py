"""Sliding-window admission on a stream.

``admit_stream``: state per key is the last ``limit`` admitted times, nothing
else.  Needs the RocksDB state store (``use_rocksdb``).  Within a micro-batch
events are taken in time order; an event older than one already admitted is
judged at the time of that one, as it arrives.  All rows that one key has in a
micro-batch are one frame.

``SettledAdmission`` has the daily cap as well, and no bound on a key's rows.  What a day has admitted decides
what keys may do on the next one, so that a key's state cannot stand before the
count by day in a chain of operators; each micro-batch goes through the batch
rule, from what the one before has left in the shared folder.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadloom.operators.admission import DAY_US, Carried, admit, admitted_positions
from roadloom.session import materialize


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Window(StatefulProcessor):
    def __init__(self, limit: int, window_us: int, ttl_ms: int | None):
        self.limit, self.window, self.ttl = limit, window_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "t bigint", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["t", "o"], ignore_index=True)
        recent = deque(sorted(t for (t,) in self.recent.get()), maxlen=self.limit)
        times = batch["t"].to_numpy()
        if recent:
            times = times.clip(min=recent[-1])
        passed = admitted_positions(times, recent, self.limit, self.window)
        self.recent.put([(int(t),) for t in recent])
        verdict = pd.Series("window", index=batch.index)
        verdict.iloc[passed] = "admitted"
        yield pd.DataFrame({"k": batch["k"], "t": batch["t"], "o": batch["o"], "verdict": verdict})

    def close(self) -> None:
        pass


def admit_stream(events: DataFrame, key: str, ts: str, order: str, limit: int, window_s: float,
                 state_ttl_s: float | None = None) -> DataFrame:
    """``key, ts, order, verdict`` as a stream (append mode).

    ``state_ttl_s`` lets the store forget keys that stay silent; give it well
    above the window, since it counts processing time.
    """
    rows = events.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"),
                         F.col(order).alias("o"))
    types = dict(rows.dtypes)
    out = rows.groupBy("k").transformWithStateInPandas(
        statefulProcessor=_Window(limit, int(window_s * 1_000_000),
                                  int(state_ttl_s * 1000) if state_ttl_s else None),
        outputStructType=f"k {types['k']}, t bigint, o {types['o']}, verdict string",
        outputMode="append", timeMode="ProcessingTime" if state_ttl_s else "None")
    return out.select(F.col("k").alias(key), F.timestamp_micros("t").cast(events.schema[ts].dataType).alias(ts),
                      F.col("o").alias(order), "verdict")


_SETTLED = "newest bigint, frontier bigint, day bigint, used bigint"


@dataclass(frozen=True)
class SettledAdmission:
    """The rule, with a daily cap or without (None), over a stream, exactly as the batch job decides it.

    Events wait until one has been seen that is ``delay_s`` newer; then they are settled in order of time.  One that
    arrives after its time has been settled gets the verdict ``late`` and counts for nothing.  ``folder`` must be shared by all
    executors.  A micro-batch writes what it settles and what it leaves to the next under its own number and reads only what
    the number before has left, so that one that is run again after a failure writes the same.  What is left is: waiting events,
    at most ``limit`` times of each key that was admitted within the window, and one row of totals.
    """

    folder: str
    key: str
    ts: str
    order: str
    limit: int
    window_s: float
    daily_cap: int | None
    delay_s: float

    def writer(self, events: DataFrame):
        """The stream's writer; choose a trigger and start it."""
        return events.writeStream.option("checkpointLocation", f"{self.folder}/progress").foreachBatch(self._settle)

    def verdicts(self, events: DataFrame) -> DataFrame:
        """``key, ts, order, verdict`` of what has been settled; ``events`` gives the types."""
        return self._read(events, f"{self.folder}/verdicts/batch=*")

    def close(self, events: DataFrame) -> DataFrame:
        """The same, with the waiting events settled as if no other would come.  The stream itself is left as it is and may
        go on."""
        spark = events.sparkSession
        last = spark.read.parquet(f"{self.folder}/totals").agg(F.max("batch")).first()[0]
        waiting = self._state(spark, "waiting", last)
        rest = f"{self.folder}/rest-{last}"
        self._judged(waiting, last, events.schema[self.ts].dataType).write.mode("overwrite").parquet(rest)
        return self.verdicts(events).unionByName(self._read(events, rest))

    def _read(self, events: DataFrame, path: str) -> DataFrame:
        schema = events.select(self.key, self.ts, self.order).schema.add("verdict", "string")
        return events.sparkSession.read.schema(schema).parquet(path)

    def _state(self, spark: SparkSession, name: str, batch: int) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}/batch={batch}")

    def _judged(self, due: DataFrame, before: int, ts_type) -> DataFrame:
        """Verdicts of ``due`` (k, t, o), all of it after what batch ``before`` has settled."""
        spark, carried = due.sparkSession, None
        if before >= 0:
            totals = self._state(spark, "totals", before).first()
            carried = Carried(self._state(spark, "recent", before), totals["day"], totals["used"])
        rows = due.select(F.col("k").alias(self.key), F.timestamp_micros("t").cast(ts_type).alias(self.ts), F.col("o").alias(self.order))
        return admit(rows, self.key, self.ts, self.order, self.limit, self.window_s, self.daily_cap, carried=carried)

    def _settle(self, batch: DataFrame, number: int) -> None:
        spark, window, ts_type = batch.sparkSession, int(self.window_s * 1_000_000), batch.schema[self.ts].dataType
        micros = F.unix_micros(F.col(self.ts).cast("timestamp"))
        came = batch.select(F.col(self.key).alias("k"), micros.alias("t"), F.col(self.order).alias("o"))
        arrived, old = materialize(came, "arrived"), None
        newest = arrived.agg(F.max("t")).first()[0]
        if number > 0:
            old = self._state(spark, "totals", number - 1).first()
            newest = max(x for x in (newest, old["newest"], -(2 ** 62)) if x is not None)
        newest = -(2 ** 62) if newest is None else newest
        settled = old["frontier"] if old else -(2 ** 62)
        frontier = max(settled, newest - int(self.delay_s * 1_000_000))
        rows = arrived.where(F.col("t") > settled)
        if number > 0:
            rows = rows.unionByName(self._state(spark, "waiting", number - 1))
        late = arrived.where(F.col("t") <= settled).select(
            F.col("k").alias(self.key), F.timestamp_micros("t").cast(ts_type).alias(self.ts), F.col("o").alias(self.order), F.lit("late").alias("verdict"))
        at = f"{self.folder}/{{}}/batch={number}"
        judged = self._judged(rows.where(F.col("t") <= frontier), number - 1, ts_type)
        judged.unionByName(late).write.mode("overwrite").parquet(at.format("verdicts"))

        passed = self._read(batch, at.format("verdicts")).where("verdict = 'admitted'").select(F.col(self.key).alias("k"), micros.alias("t"))
        day = frontier // DAY_US
        used = passed.where(F.floor(F.col("t") / DAY_US) == day).count() + (old["used"] if old and old["day"] == day else 0)
        recent = passed if old is None else passed.unionByName(self._state(spark, "recent", number - 1))
        order = Window.partitionBy("k").orderBy(F.desc("t"))
        recent = recent.where(F.col("t") > frontier - window).withColumn("n", F.row_number().over(order)).where(F.col("n") <= self.limit)
        recent.select("k", "t").write.mode("overwrite").parquet(at.format("recent"))
        rows.where(F.col("t") > frontier).write.mode("overwrite").parquet(at.format("waiting"))
        totals = spark.createDataFrame([(newest, frontier, day, used)], _SETTLED)
        totals.coalesce(1).write.mode("overwrite").parquet(at.format("totals"))
