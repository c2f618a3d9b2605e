"""Streaming forms of the log reports.

Event time is the bucket's start and a bucket may be flushed again later, so the
watermark must exceed the flush lag; rows later than that are left to the batch jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import dims
from ..operators import series
from ..sources.logs import SESSIONS, USAGE


def stream_usage(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Usage rows of a folder of JSONL files as they arrive."""
    reader = spark.readStream.schema(USAGE).option("mode", "DROPMALFORMED")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path).withColumn("hour_start", F.try_to_timestamp(F.col("hour_start")))


def stream_session_snapshots(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.readStream.schema(SESSIONS).option("mode", "DROPMALFORMED").json(path)
    return rows.where("session_key <> ''").withColumns({c: F.try_to_timestamp(F.col(c)) for c in ("started_at", "last_message_at", "snapshot_at")})


def usage_hourly(usage: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Sums by hour, source and model; an hour is final once the watermark has passed it."""
    rows = usage.where("hour_start is not null").withWatermark("hour_start", delay)
    grouped = rows.groupBy(F.window("hour_start", "1 hour"), dims.or_unknown("source").alias("source"), dims.normalise_model("model").alias("model"))
    sums = grouped.agg(F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("events"))
    return sums.select(F.col("window.start").alias("hour"), "source", "model", "tokens", "events")


def sessionize(events: DataFrame, key: str, time: str, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Runs of a key's events with gaps of at most ``gap``."""
    grouped = events.withWatermark(time, delay).groupBy(F.session_window(time, gap), F.col(key))
    return grouped.agg(F.count(F.lit(1)).alias("events")).select(key, F.col("session_window.start").alias("started_at"), "events")


def latest_sessions_sink(snapshots: DataFrame, read: Callable[[SparkSession], DataFrame | None], write: Callable[[DataFrame], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the latest snapshot of each session: every batch is merged with what ``read`` gives
    and handed to ``write``, which must replace the table as a whole. A repeated batch changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        old = read(batch.sparkSession)
        rows = batch if old is None else old.unionByName(batch)
        best = F.max_by(F.struct(*rows.columns), F.struct("snapshot_at", -F.col("total_messages")))
        write(rows.groupBy("session_key").agg(best.alias("r")).select("r.*"))

    return snapshots.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "1 minute"}).start()


def anomaly_alerts(usage: DataFrame, log: Callable[[SparkSession], DataFrame], as_of_day: Callable[[], int], alert: Callable[[DataFrame], None], checkpoint: str, **trigger) -> StreamingQuery:
    """After each batch, hand the flagged days of the whole log to ``alert``."""

    def run(batch: DataFrame, _: int) -> None:
        flagged = series.anomalies(log(batch.sparkSession), as_of_day()).where(F.col("status").isin("high", "low"))
        alert(flagged)

    return usage.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "10 minutes"}).start()
