"""Sliding-window admission of events, as a batch job.

An event of a key is admitted iff fewer than ``limit`` events of that key were
admitted in the last ``window_s`` seconds; refused events do not count.  An
optional daily cap over all keys is checked first.

The rule is sequential per key, and one key may own any share of the events, so
a key is never handed to one task as a whole.  Time is cut into chunks; every
(key, chunk) is evaluated on its own from the times admitted shortly before it.
All chunks start from "nothing admitted before"; then the chunks whose starting
point turned out different are evaluated again, until none is left.  By
induction over time the result is the sequential one.  Quiet stretches longer
than the window settle at once, so few rounds touch more than a small part.

With a limit of 1 and no cap the rounds are not needed (``_starts_by_pointers``):
what a chunk can be left with are few single times, so each chunk becomes a map
from one such time to the next, and the maps are composed by pointer doubling.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.session import materialize

DAY_US = 86_400_000_000


def admitted_positions(times: np.ndarray, recent: deque, limit: int, window: int) -> list[int]:
    """Positions admitted among ascending ``times``.  ``recent`` holds the last
    ``limit`` admitted times and is updated.  Runs of refused events are
    skipped by search, so the cost follows the admitted ones."""
    out, i = [], 0
    while i < len(times):
        if len(recent) < limit or times[i] - recent[0] > window:
            out.append(i)
            recent.append(int(times[i]))
            i += 1
        else:
            i = int(np.searchsorted(times, recent[0] + window, side="right"))
    return out


@dataclass(frozen=True)
class Carried:
    """What an earlier stretch of time leaves to a later one: the times admitted last (k, t in microseconds, all of them
    before the later stretch), the day in which the earlier one ended and how many events that day has admitted."""

    recent: DataFrame
    day: int
    used: int


def admit(events: DataFrame, key: str, ts: str, order: str, limit: int, window_s: float,
          daily_cap: int | None = None, chunk_s: int | None = None, carried: Carried | None = None) -> DataFrame:
    """Adds ``verdict`` (admitted, window, cap) to ``key, ts, order``.

    ``order`` breaks ties in time and makes (key, ts, order) unique.  A chunk is
    32 windows long, and at least a day, unless ``chunk_s`` says otherwise; with
    a daily cap it must be a whole fraction of a day and is a day by default.
    ``carried`` continues an earlier stretch of time; no event may be older than it.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if chunk_s is None:
        chunk_s = 86_400 if daily_cap is not None else max(86_400, int(32 * window_s))
    if daily_cap is not None and 86_400 % chunk_s:
        raise ValueError("chunk_s must divide a day when there is a daily cap")
    window, chunk_us = int(window_s * 1_000_000), int(chunk_s * 1_000_000)
    base = materialize(events.select(
        F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(order).alias("o"))
        .withColumn("chunk", F.floor(F.col("t") / chunk_us).cast("bigint")), "visits")
    chunk = ["k", "chunk"]
    chunks = base.select(*chunk).distinct()
    none = F.array().cast("array<bigint>")
    used = None
    if limit == 1 and daily_cap is None and carried is None and chunk_us >= window:
        starts = _starts_by_pointers(base, window, chunk_us)
        admitted = materialize(_evaluate(base, starts, limit, window), "admitted")
        return _verdicts(base, admitted, events, key, ts, order, None, None)
    admitted = materialize(_evaluate(base, None, limit, window), "admitted")
    while True:
        starts = chunks.join(_starts(_under_cap(admitted, daily_cap, carried), limit, window, chunk_us, carried), chunk, "left").select(
            *chunk, F.coalesce("start", none).alias("start"))
        if used is None:
            starts = starts.withColumn("was", none)
        else:
            starts = starts.join(used.select(*chunk, F.col("start").alias("was")), chunk)
        used = materialize(starts.select(*chunk, "start", (F.col("start") != F.col("was")).alias("changed")), "starts")
        changed = used.where("changed")
        if changed.isEmpty():
            break
        rows = base.join(changed.select(*chunk), chunk, "left_semi").select(*base.columns)
        kept = admitted.join(changed.select(*chunk), chunk, "left_anti").select(*base.columns)
        admitted = materialize(kept.unionByName(_evaluate(rows, changed, limit, window)), "admitted")
    return _verdicts(base, admitted, events, key, ts, order, daily_cap, carried)


def _verdicts(base: DataFrame, admitted: DataFrame, events: DataFrame, key: str, ts: str, order: str,
              daily_cap: int | None, carried: Carried | None) -> DataFrame:
    verdicts = base.join(_under_cap(admitted, daily_cap, carried).select("k", "t", "o", F.lit(True).alias("ok")),
                         ["k", "t", "o"], "left")
    verdict = F.when(F.col("ok"), "admitted")
    if daily_cap is not None:
        full = (_under_cap(admitted, daily_cap, carried).groupBy("day").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct("t", "o")).alias("last"))
            .where(F.col("n") >= _left(daily_cap, carried)).select("day", "last"))
        # A row per day, so a broadcast is bounded by the calendar; a busy day stays spread out.
        verdicts = verdicts.withColumn("day", F.floor(F.col("t") / DAY_US)).join(F.broadcast(full), "day", "left")
        verdict = verdict.when((_left(daily_cap, carried) <= 0) | (F.struct("t", "o") > F.col("last")), "cap")
    return verdicts.select(
        F.col("k").alias(key), F.timestamp_micros("t").cast(events.schema[ts].dataType).alias(ts),
        F.col("o").alias(order), verdict.otherwise("window").alias("verdict"))


def _evaluate(rows: DataFrame, starts: DataFrame | None, limit: int, window: int) -> DataFrame:
    """The admitted rows of every (key, chunk), given the times admitted before.

    Those times become rows of their own that sort first.  Each partition is
    then one sorted run, read batch by batch: no chunk is ever held as a whole.
    """
    rows = rows.withColumn("seed", F.lit(False))
    if starts is not None:
        seeds = starts.select("k", "chunk", F.explode("start").alias("t"), F.lit(True).alias("seed"))
        rows = rows.unionByName(seeds, allowMissingColumns=True)
    run = rows.repartition("k", "chunk").sortWithinPartitions("k", "chunk", F.desc("seed"), "t", "o")

    def scan(batches):
        current, recent = None, deque(maxlen=limit)
        for pdf in batches:
            k = pdf["k"].astype(object).where(pdf["k"].notna(), None).to_numpy()
            chunk, t, seed = pdf["chunk"].to_numpy(), pdf["t"].to_numpy(), pdf["seed"].to_numpy()
            new = np.flatnonzero((k[1:] != k[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            keep = []
            for a, b in zip([0, *new], [*new, len(pdf)]):
                if (k[a], chunk[a]) != current:
                    current, recent = (k[a], chunk[a]), deque(maxlen=limit)
                first = a + int(np.count_nonzero(seed[a:b]))
                recent.extend(int(x) for x in t[a:first])
                keep += [first + i for i in admitted_positions(t[first:b], recent, limit, window)]
            yield pdf.iloc[keep].drop(columns="seed")

    return run.mapInPandas(scan, rows.drop("seed").schema)


#: The state in which nothing has been admitted within the window.
_NOTHING = -(2 ** 61)


class _Chains:
    """What becomes of several possible states (the time admitted last) as events of one key pass by.  States that admit the same
    event are one from then on; each knows where it began.  While ``open_until`` has not been passed every event begins one."""

    def __init__(self, window: int, open_until: int | None = None):
        self.window, self.open_until, self.live = window, open_until, deque()

    def seed(self, t: int) -> None:
        self.live.append([t, [t], False])

    def _admit(self, t: int, begins: bool) -> None:
        origins = []
        while self.live and self.live[0][0] + self.window < t:
            origins += self.live.popleft()[1]
            begins = True
        if begins and not (self.live and self.live[-1][0] == t):
            self.live.append([t, origins, True])

    def take(self, times: np.ndarray) -> None:
        i = 0
        while i < len(times):
            if self.open_until is not None:
                t = int(times[i])
                self._admit(t, True)
                if t > self.open_until:
                    self.open_until = None
                i += 1
                continue
            if not self.live:
                return
            i = max(i, int(np.searchsorted(times, self.live[0][0] + self.window, side="right")))
            if i < len(times):
                self._admit(int(times[i]), False)
                i += 1


def _followed(rows: DataFrame, window: int, chunk_us: int, begin: bool, schema: str) -> DataFrame:
    """(key, chunk) runs of events, after their seeds, to what each possible state becomes."""
    run = rows.repartition("k", "chunk").sortWithinPartitions("k", "chunk", F.desc("seed"), "t").select("k", "chunk", "t", "seed")

    def scan(batches):
        current, chains = None, None

        def ends():
            if chains is None:
                return []
            live = [(at, origin, moved) for at, origins, moved in chains.live for origin in (origins if not begin else [at])]
            return [(*current, origin, at if moved else _NOTHING) for at, origin, moved in live]

        for pdf in batches:
            k = pdf["k"].astype(object).where(pdf["k"].notna(), None).to_numpy()
            chunk, t, seed = pdf["chunk"].to_numpy(), pdf["t"].to_numpy(), pdf["seed"].to_numpy()
            new = np.flatnonzero((k[1:] != k[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            out = []
            for a, b in zip([0, *new], [*new, len(pdf)], strict=True):
                if a == b:
                    continue
                if (k[a], int(chunk[a])) != current:
                    out += ends()
                    current = (k[a], int(chunk[a]))
                    chains = _Chains(window, current[1] * chunk_us + window if begin else None)
                first = a + int(np.count_nonzero(seed[a:b]))
                for x in t[a:first]:
                    chains.seed(int(x))
                chains.take(t[first:b])
            yield pd.DataFrame(out, columns=["k", "chunk", "start", "after"])
        yield pd.DataFrame(ends(), columns=["k", "chunk", "start", "after"])

    return run.mapInPandas(scan, schema)


def _starts_by_pointers(base: DataFrame, window: int, chunk_us: int) -> DataFrame:
    """The state in which every (key, chunk) really starts, for a limit of 1 and chunks not shorter than the window.

    An event that a chunk admits first lies within a window of its beginning, or is the next one, whatever came before: so the times
    a chunk can be left with are known from the chunk alone.  They seed the chunk after it; a state under which a chunk admits
    nothing is out of reach when the next one begins.  Nodes are (key, chunk, state before it), each with one successor; those
    that can be reached from the first chunk of a key are found by doubling, in as many steps as the number of chunks has
    binary digits.  Keys meet their own chunks only, and a hot key has one row for each chunk and state.
    """
    rows, fields = base.withColumn("seed", F.lit(False)), f"k {dict(base.dtypes)['k']}, chunk bigint, start bigint, after bigint"
    left = materialize(_followed(rows, window, chunk_us, True, fields).select("k", "chunk", "after"), "left")
    order = Window.partitionBy("k").orderBy("chunk")
    chunks = base.select("k", "chunk").distinct().select("k", "chunk", F.lead("chunk").over(order).alias("next"), F.row_number().over(order).alias("no"))
    chunks = materialize(chunks, "chunks")
    most = chunks.agg(F.max("no")).first()[0] or 0
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    seeds = left.join(chunks, same(left, chunks, "k", "chunk"), "left").select(left["k"], F.col("next").alias("chunk"), F.col("after").alias("t")).where("chunk is not null")
    seeds = seeds.unionByName(chunks.select("k", "chunk", F.lit(_NOTHING).alias("t"))).withColumn("seed", F.lit(True))
    found = _followed(rows.select("k", "chunk", "t", "seed").unionByName(seeds), window, chunk_us, False, fields)
    to = found.join(chunks, same(found, chunks, "k", "chunk")).select(found["k"], found["chunk"], "start", F.col("next").alias("to_chunk"), F.col("after").alias("to_start"))
    jumps = materialize(to.where("to_chunk is not null"), "jumps")
    reached = chunks.where("no = 1").select("k", "chunk", F.lit(_NOTHING).alias("start"))
    for step in range(max(most - 1, 0).bit_length()):
        here = reached.alias("a").join(jumps.alias("b"), F.expr("a.k <=> b.k AND a.chunk = b.chunk AND a.start = b.start"))
        reached = materialize(reached.unionByName(here.selectExpr("a.k AS k", "b.to_chunk AS chunk", "b.to_start AS start")), "reached")
        twice = jumps.alias("a").join(jumps.alias("b"), F.expr("a.k <=> b.k AND a.to_chunk = b.chunk AND a.to_start = b.start"))
        jumps = materialize(twice.selectExpr("a.k AS k", "a.chunk AS chunk", "a.start AS start", "b.to_chunk AS to_chunk", "b.to_start AS to_start"), "jumps")
    return reached.where(F.col("start") != _NOTHING).select("k", "chunk", F.array("start").alias("start"))


def _left(daily_cap: int, carried: Carried | None):
    """How many events a ``day`` may still admit."""
    if carried is None:
        return F.lit(daily_cap)
    return F.when(F.col("day") == carried.day, daily_cap - carried.used).otherwise(daily_cap)


def _under_cap(admitted: DataFrame, daily_cap: int | None, carried: Carried | None = None) -> DataFrame:
    """The first ``daily_cap`` admitted events of each day.  Spark keeps only
    that many per day and task before it shuffles."""
    rows = admitted.withColumn("day", F.floor(F.col("t") / DAY_US))
    if daily_cap is None:
        return rows
    order = Window.partitionBy("day").orderBy("t", "o")
    first = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= daily_cap)
    return first.where(F.col("n") <= _left(daily_cap, carried)).drop("n")


def _starts(admitted: DataFrame, limit: int, window: int, chunk_us: int, carried: Carried | None = None) -> DataFrame:
    """For every (key, chunk), the last ``limit`` times admitted in the window
    before the chunk begins.  The limit itself bounds the list."""
    last = F.floor((F.col("t") + window) / chunk_us).cast("bigint")
    rows = admitted.select("k", "t", (F.col("chunk") + 1).alias("first"))
    if carried is not None:     # times from before the first event begin chunks, that of their own included
        rows = rows.unionByName(carried.recent.select("k", "t", F.floor(F.col("t") / chunk_us).cast("bigint").alias("first")))
    reach = F.when(last >= F.col("first"), F.sequence("first", last))
    times = F.sort_array(F.collect_list("t"))
    return (rows.select("k", "t", F.explode(reach).alias("chunk"))
            .groupBy("k", "chunk").agg(F.slice(times, F.greatest(F.size(times) - limit, F.lit(0)) + 1, F.lit(limit))
                                       .alias("start")))
