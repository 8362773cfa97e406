"""Alerts over a stream of files: late and repeated batches, suppression, upserts that survive a repeated batch."""

import datetime as dt
import os
import pathlib

from pyspark.sql import functions as F

from tidewater.streaming import alerts

SCHEMA = "ts timestamp, kind string"


def put(spark, folder, name, rows):
    spark.createDataFrame([(dt.datetime(2024, 1, d, h), k) for d, h, k in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")
    for f in pathlib.Path(folder, name).iterdir():  # the stream takes files by their time
        os.utime(f, (1_700_000_000 + ord(name), 1_700_000_000 + ord(name)))


def run(spark, folder, table, checkpoint):
    events = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
    rates = alerts.daily_rates(events, "ts", "kind", "buy", late="2 days", timed=True)
    hooks = spark.createDataFrame([(1, "buying", "all", ">", 0.5, "high"), (2, "buying", "all", "<", 0.2, "low")], "id int, metric string, scope string, op string, threshold double, severity string")
    alerts.watch_hooks(rates, hooks, "buying", table, checkpoint).awaitTermination()


def test_hooks_over_a_stream(spark, tmp_path):
    folder, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    put(spark, folder, "a", [(1, h, "buy") for h in range(4)] + [(1, 5, "see")])  # 1 January: 0.8, hook 1
    put(spark, folder, "b", [(2, h, "buy") for h in range(4)] + [(1, 6, "buy")])  # 2 January fires too, within the delay: quiet; a late row of the 1st counts
    put(spark, folder, "c", [(9, h, "see") for h in range(4)])  # 9 January: 0, hook 2
    put(spark, folder, "d", [(9, 5, "see")])  # Spark drops late rows by the watermark of the batch before
    put(spark, folder, "e", [(1, 7, "see")] * 50)  # too late: dropped
    put(spark, folder, "f", [(15, 1, "see"), (20, 1, "see"), (30, 1, "see")])
    run(spark, folder, table, checkpoint)
    got = {r.id: r for r in alerts.current_alerts(spark, table).collect()}
    rows = spark.read.parquet(table).collect()
    fired = [(r.window_start.day, r.value) for r in rows if r.id == 1]
    assert fired in ([(1, 5 / 6)], [(2, 1.0)])  # both windows close at once, and one of them speaks
    quiet = [r.window_start.day for r in rows if r.id == 2]
    assert len(quiet) == 1 and quiet[0] in (9, 15, 20) and got[2].severity == "low"  # never the first, which the late rows would have pulled down
    before = sorted((r.id, r.window_start) for r in rows)
    run(spark, folder, table, checkpoint)  # nothing new
    assert sorted((r.id, r.window_start) for r in spark.read.parquet(table).collect()) == before


def test_a_repeated_batch_takes_its_own_place(spark, tmp_path):
    table = str(tmp_path / "table")
    batch = spark.createDataFrame([(1, "m", "all", dt.datetime(2024, 1, 1), 0.9)], "id int, metric string, scope string, window_start timestamp, value double")
    for epoch in (0, 0, 1, 1):
        alerts.upsert_alerts(batch.withColumn("value", F.col("value") + epoch), epoch, table)
    assert [r.value for r in alerts.current_alerts(spark, table).collect()] == [1.9] and spark.read.parquet(table).count() == 2
