"""Threshold alerts over a stream: daily event rates in watermarked windows against a table of hooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_rates(events: DataFrame, ts: str, kind: str, wanted: str, late: str = "1 day", width: str = "1 day", timed: bool = False) -> DataFrame:
    """Rows (window_start, n, hits, value) of tumbling windows, ``timed``: with window_time, which carries a stream's watermark on; for streams and tables alike."""
    dated = events.withWatermark(ts, late) if events.isStreaming else events
    g = dated.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(kind) == wanted).alias("hits"))
    more = [F.window_time("w").alias("window_time")] if timed else []
    return g.select(F.col("w.start").alias("window_start"), *more, "n", "hits", (F.col("hits") / F.col("n")).alias("value"))


def alerts(rates: DataFrame, low: float, high: float) -> DataFrame:
    """Windows whose rate is strictly outside (low, high)."""
    side = F.when(F.col("value") < low, "below").when(F.col("value") > high, "above")
    return rates.withColumn("alert", side).where("alert is not null")


def watch(rates: DataFrame, low: float, high: float, sink: str, checkpoint: str):
    """Start writing a stream's alerts to a Parquet folder, batch by batch, exactly once per window."""

    def put(batch: DataFrame, epoch: int) -> None:
        alerts(batch, low, high).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(sink)

    return rates.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def hook_alerts(rates: DataFrame, hooks: DataFrame, metric: str) -> DataFrame:
    """Rows (id, metric, scope, window_start, value, op, threshold, severity) of hooks (id, metric, scope, op, threshold, severity) that rates fire. ``rates`` are rows
    (window_start, value, optionally scope) of one metric, for streams also window_time; the hooks are a table that is joined to them, broadcast if Spark finds it small.

    On a stream a hook that has fired for a scope is quiet about it until the watermark has passed that window by its delay: the state keeps one row a hook and scope, and late or
    repeated rows add none. Of windows that close in one batch any one speaks.
    """
    scoped = rates if "scope" in rates.columns else rates.withColumn("scope", F.lit("all"))
    j = scoped.withColumn("metric", F.lit(metric)).join(hooks, ["metric", "scope"])
    fired = F.when(F.col("op") == "<", F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    out = j.where(fired)
    if rates.isStreaming:
        out = out.dropDuplicatesWithinWatermark(["id", "metric", "scope"])
    return out.select("id", "metric", "scope", "window_start", "value", "op", "threshold", "severity")


def upsert_alerts(batch: DataFrame, epoch: int, table: str) -> None:
    """Write one batch's alerts as a part of ``table`` of its own: written again, it takes its own place, so a batch that is repeated after a failure counts once."""
    batch.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")


def current_alerts(spark: SparkSession, table: str) -> DataFrame:
    """The latest alert of each hook and scope: later batches take the place of earlier ones; of one batch the latest window."""
    rows = spark.read.option("basePath", table).parquet(f"{table}/epoch=*")
    cols = [c for c in rows.columns if c not in ("id", "scope")]
    return rows.groupBy("id", "scope").agg(F.max(F.struct("epoch", "window_start", *[c for c in cols if c not in ("epoch", "window_start")])).alias("x")).select("id", "scope", *[F.col(f"x.{c}") for c in cols])


def watch_hooks(rates: DataFrame, hooks: DataFrame, metric: str, table: str, checkpoint: str):
    """Start keeping the hooks' alerts over a stream of rates in ``table``, exactly once a batch."""
    found = hook_alerts(rates, hooks, metric)
    return found.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: upsert_alerts(batch, epoch, table)).trigger(availableNow=True).start()
