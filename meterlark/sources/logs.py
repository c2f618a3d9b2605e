"""Usage and session logs: schemas, scans, exports."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dims
from . import scan

_TOKENS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")

USAGE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("source", "model", "hour_start", "device_id")]
    + [T.StructField(c, T.LongType()) for c in _TOKENS]
)
SESSIONS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("session_key", "source", "kind", "started_at", "last_message_at")]
    + [T.StructField(c, T.LongType()) for c in ("duration_seconds", "user_messages", "assistant_messages", "total_messages")]
    + [T.StructField(c, T.StringType()) for c in ("project_ref", "model", "snapshot_at")]
)
RUNS = T.StructType(
    [
        T.StructField("runId", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("startedAt", T.StringType()),
        T.StructField("completedAt", T.StringType()),
    ]
)


def scan_usage(spark: SparkSession, path: str) -> DataFrame:
    """Every line of a usage log, malformed ones marked (``scan.scan``)."""
    return scan.scan(spark, path, _timed(USAGE, "hour_start"))


def scan_session_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Every line of a session log, malformed ones marked."""
    return scan.scan(spark, path, _timed(SESSIONS, "started_at", "last_message_at", "snapshot_at"))


def _timed(schema: T.StructType, *times: str) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.TimestampType()) if f.name in times else f for f in schema])


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage rows of a JSONL log; blank and malformed lines are skipped (``scan.counts`` counts them)."""
    return scan.rows_of(scan_usage(spark, path))


def read_session_snapshots(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    """Every session snapshot of a JSONL log that has a key; ``position`` keeps the place of each, which decides ties."""
    return scan.rows_of(scan_session_snapshots(spark, path), position).where("session_key is not null and session_key <> ''")


def read_runs(spark: SparkSession, path: str, since: str | None = None, limit: int | None = None, lines: bool = False) -> DataFrame:
    """Runs with their name: one file each, named by the file, or with ``lines`` one line each, named by the run;
    without a run id a file or line is skipped. ``limit`` keeps the latest names."""
    rows = scan.rows_of(scan.scan(spark, path, RUNS, whole=not lines), position=True).where("runId is not null and runId <> ''")
    name = F.col("runId") if lines else F.element_at(F.split("_position.file", "/"), -1)
    rows = rows.withColumn("name", name).drop("_position")
    if since:
        rows = rows.where(F.col("name") >= since)
    return rows.orderBy(F.desc("name")).limit(limit) if limit else rows


def latest_sessions(snapshots: DataFrame) -> DataFrame:
    """The snapshot of each key with the largest ``snapshot_at``; of equals, the first in the file.

    The place in the file is the column ``_position`` of ``read_session_snapshots(..., position=True)``,
    and is dropped; without it the snapshot with the fewest messages, then the earliest last message,
    stands for the first. One partial aggregate: a key with a third of all snapshots is a row per task.
    """
    # The smallest place of the smallest negated time; a null time is the oldest.
    age = F.coalesce(-F.unix_micros(F.col("snapshot_at").cast("timestamp")), F.lit((1 << 63) - 1)).alias("age")
    placed = "_position" in snapshots.columns
    tie = ["_position"] if placed else ["total_messages", "last_message_at"]
    rows = snapshots.groupBy(F.col("session_key").alias("_key")).agg(F.min_by(F.struct(*snapshots.columns), F.struct(age, *tie)).alias("_row"))
    return rows.select("_row.*").drop("_position")


def since_of(spec: str, now: datetime) -> str | None:
    """Lower bound from ``24h``, ``7d``, ``2w``, ``1m`` (30 days), ``all`` or an ISO time."""
    if spec == "all":
        return None
    found = re.fullmatch(r"(\d+)([hdwm])", spec)
    if not found:
        return datetime.fromisoformat(spec.replace("Z", "+00:00")).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    hours = int(found[1]) * {"h": 1, "d": 24, "w": 168, "m": 720}[found[2]]
    return (now - timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def _matching(df: DataFrame, source: str | None, model: str | None) -> DataFrame:
    """Rows whose source and normalised model contain the given strings, whatever the case."""
    for column, part in (("source", source), ("normalised_model", model)):
        if part:
            df = df.where(F.lower(column).contains(part.lower()))
    return df


def export_usage(usage: DataFrame, rates: DataFrame, since=None, until=None, source=None, model=None) -> DataFrame:
    """Usage rows with the normalised model and their cost in USD (8 decimals; unknown models cost 0)."""
    rows = dims.within(usage, "hour_start", since, until).withColumn("normalised_model", dims.normalise_model("model"))
    priced = dims.with_cost(_matching(rows, source, model), rates, "normalised_model")
    return priced.select(
        dims.iso("hour_start").alias("hour_start"), "source", "model", "normalised_model", "device_id", *_TOKENS, F.round("usd", 8).alias("usd")
    )


def export_sessions(sessions: DataFrame, since=None, until=None, source=None, model=None) -> DataFrame:
    """Sessions by their last message, with the normalised model."""
    rows = dims.within(sessions, "last_message_at", since, until).withColumn("normalised_model", dims.normalise_model("model"))
    return _matching(rows, source, model).select(
        "session_key", "source", "kind", dims.iso("started_at").alias("started_at"), dims.iso("last_message_at").alias("last_message_at"),
        "duration_seconds", "user_messages", "assistant_messages", "total_messages", "project_ref", "model", "normalised_model",
        dims.iso("snapshot_at").alias("snapshot_at"),
    )
