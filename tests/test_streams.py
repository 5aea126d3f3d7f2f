import datetime
import json

import pytest
from pyspark.sql import functions as F

from roadloom.operators import admission
from roadloom.streaming import admission as stream_admission
from roadloom.streaming import monitor


def _run(stream, tmp_path, name):
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / name)).outputMode("append")
         .option("checkpointLocation", str(tmp_path / f"{name}-progress")).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.parquet(str(tmp_path / name))


def test_admission_stream_over_several_batches_equals_batch(spark, tmp_path):
    stream_admission.use_rocksdb(spark)
    rows = [(f"u{i % 3}", i * 137 % 4000 + 4000 * (i // 40), i) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, s bigint, id bigint").withColumn("ts", F.timestamp_seconds("s"))
    for batch in range(3):
        df.where(F.col("id").between(batch * 40, batch * 40 + 39)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _run(stream_admission.admit_stream(stream, "k", "ts", "id", 2, 900), tmp_path, "out")
    want = admission.admit(df, "k", "ts", "id", 2, 900)
    verdicts = lambda d: {r["id"]: r["verdict"] for r in d.collect()}
    assert verdicts(got) == verdicts(want) and len(verdicts(got)) == 120


def _visits(n=240):
    """Four days; one key has half of the rows, some times come twice."""
    return [("busy" if i % 2 else f"u{i % 7}", (i // 3) * 4_311 + i % 2, i) for i in range(n)]


def _sent(spark, path, rows, sizes):
    """Rows as files of the given sizes, in order."""
    df = spark.createDataFrame(rows, "k string, s bigint, id bigint").withColumn("ts", F.timestamp_seconds("s"))
    at = 0
    for size in sizes:
        df.where(F.col("id").isin([r[2] for r in rows[at:at + size]])).coalesce(1).write.mode("append").parquet(path)
        at += size
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("limit, window, cap, delay", [(1, 21_600, 9, 5_000), (3, 100_000, 11, 0), (2, 7_200, None, 50_000), (1, 600, 1, 500_000)])
def test_settled_admission_equals_batch(spark, tmp_path, limit, window, cap, delay):
    rows = sorted(_visits(), key=lambda r: r[1:])
    for i in range(0, len(rows) - 4, 4):
        rows[i], rows[i + 1] = rows[i + 1], rows[i]      # out of order by less than any delay but none
    if not delay:
        rows = sorted(_visits(), key=lambda r: r[1:])
    df, stream = _sent(spark, str(tmp_path / "in"), rows, [60, 3, 90, 87])
    rule = stream_admission.SettledAdmission(str(tmp_path / "run"), "k", "ts", "id", limit, window, cap, delay)
    rule.writer(stream).trigger(availableNow=True).start().awaitTermination()
    want = {r["id"]: r["verdict"] for r in admission.admit(df, "k", "ts", "id", limit, window, cap).collect()}
    settled = {r["id"]: r["verdict"] for r in rule.verdicts(df).collect()}
    assert settled.items() <= want.items() and (len(settled) < len(want)) == (delay > 0)
    assert {r["id"]: r["verdict"] for r in rule.close(df).collect()} == want
    assert rule.close(df).count() == len(rows)


def test_settled_admission_goes_on_and_names_late_events(spark, tmp_path):
    rows = sorted(_visits(120), key=lambda r: r[1:])
    first, second = rows[:70], [*rows[80:], *rows[70:80]]      # ten come after their time
    rule = stream_admission.SettledAdmission(str(tmp_path / "run"), "k", "ts", "id", 1, 21_600, 4, 0)
    df, stream = _sent(spark, str(tmp_path / "in"), first, [70])
    rule.writer(stream).trigger(availableNow=True).start().awaitTermination()
    assert rule.close(df).count() == 70
    more, stream = _sent(spark, str(tmp_path / "in"), second, [40, 10])
    rule.writer(stream).trigger(availableNow=True).start().awaitTermination()
    got = {r["id"]: r["verdict"] for r in rule.close(df).collect()}
    in_time = df.unionByName(more.where(~F.col("id").isin([r[2] for r in rows[70:80]])))
    want = {r["id"]: r["verdict"] for r in admission.admit(in_time, "k", "ts", "id", 1, 21_600, 4).collect()}
    assert got == want | {r[2]: "late" for r in rows[70:80]}
    # a batch that runs again finds what the one before has left, and writes the same
    rule._settle(more.where(F.col("id").isin([r[2] for r in second[:40]])), 1)
    assert {r["id"]: r["verdict"] for r in rule.close(df).collect()} == got


def test_turn_monitor_drops_late_turns_and_emits_closed_windows(spark, tmp_path):
    def turn(ts, ok=True):
        return json.dumps({"ts": ts, "seconds": 2.0, "queries": [{"sql": "x", "ok": ok}]}) + "\n"

    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.json").write_text(turn("2026-01-01T00:10:00") + turn("2026-01-01T00:20:00", False))
    (folder / "b.json").write_text(turn("2026-01-01T06:00:00"))
    (folder / "c.json").write_text(turn("2026-01-01T06:10:00"))
    (folder / "d.json").write_text(turn("2026-01-01T00:30:00") + turn("2026-01-01T09:30:00"))      # too late
    import os
    for i, name in enumerate("abcd"):
        os.utime(folder / f"{name}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = monitor.turn_windows(monitor.read_turn_stream(spark, str(folder), 1), "1 hour", "2 hours")
    rows = _run(stream, tmp_path, "windows").orderBy("window_start").collect()
    assert [r["window_start"] for r in rows] == [datetime.datetime(2026, 1, 1, 0), datetime.datetime(2026, 1, 1, 6)]
    assert (rows[0]["turns"], rows[0]["turns_with_failure"], rows[0]["mean_seconds"]) == (2, 1, 2.0)


def test_turn_monitor_on_a_table(spark):
    df = spark.createDataFrame([(datetime.datetime(2026, 1, 1, 0, 5), 1.0, [(True,)])], "ts timestamp, seconds double, queries array<struct<ok boolean>>")
    assert monitor.turn_windows(df).first()["turns"] == 1
