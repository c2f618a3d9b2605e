"""The driver's tables seen as usage and session logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, order, storage
from .logs import latest_sessions

# The raw model names of the adapter, by number.
MODELS = (
    "claude-opus-4-7",
    "github_copilot/claude-opus-4.7",
    "gpt-5.4",
    "gpt-5.2",
    "Claude Haiku 4.5",
    "gemini-3-pro-preview",
    "<synthetic>",
)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _model() -> F.Column:
    names = F.array(*[F.lit(m) for m in MODELS])
    return names[F.pmod(F.col("user_id") * 3 + F.col("event_id"), F.lit(7)).cast("int")]


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    zero = F.col("event_id") % 97 == 0

    def tokens(x):
        return F.when(zero, F.lit(0)).otherwise(x).cast("long")

    rows = _events(spark, sf_dir).select(
        F.col("event_type").alias("source"),
        _model().alias("model"),
        F.date_trunc("hour", "ts").alias("hour_start"),
        F.concat(F.lit("d"), (F.col("user_id") % 12).cast("string")).alias("device_id"),
        tokens(F.round(F.col("value") * 100)).alias("input_tokens"),
        tokens(k * 10).alias("cached_input_tokens"),
        tokens((F.col("event_id") * 7919) % 5000).alias("output_tokens"),
        F.when(zero | (F.col("event_type") != "purchase"), F.lit(0)).otherwise(k).cast("long").alias("reasoning_output_tokens"),
    )
    total = F.col("input_tokens") + F.col("cached_input_tokens") + F.col("output_tokens") + F.col("reasoning_output_tokens")
    return rows.withColumn("total_tokens", total)


def session_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with gaps of at most six hours; every event is a snapshot.

    The events are one order by (user, time): a user with a third of all events, or a session that
    never ends, goes over many tasks, and what a session has so far goes on from one to the next.
    """
    events = _events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    o = order.with_previous(events, "user_id", "ts", "event_id")
    same_user = F.col("prev.user_id").eqNullSafe(F.col("user_id")) & F.col("prev").isNotNull()
    new = ~same_user | (F.col("ts") > F.col("prev.ts") + F.expr("INTERVAL '6' HOUR"))
    o = order.running(o.withColumn("new", new.cast("long")).drop("prev"), ["user_id"], {"sn": F.col("new")})
    asked = F.col("event_type").isin("click", "purchase", "signup")
    o = order.running(
        o, ["user_id", "sn"], {"user_messages": asked.cast("long"), "total_messages": F.lit(1).cast("long")},
        {"source": F.col("event_type"), "started_at": F.col("ts")},
    )
    return o.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("sn").cast("string")).alias("session_key"),
        "source",
        F.when(F.col("user_id") % 3 == 0, "agent").otherwise("human").alias("kind"),
        "started_at",
        F.col("ts").alias("last_message_at"),
        "user_messages",
        "total_messages",
        F.concat(F.lit("p"), (F.col("user_id") % 25).cast("string")).alias("project_ref"),
        _model().alias("model"),
        F.col("ts").alias("snapshot_at"),
    ).withColumns(
        {
            "assistant_messages": F.col("total_messages") - F.col("user_messages"),
            "duration_seconds": F.expr("timestampdiff(SECOND, started_at, last_message_at)"),
        }
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_sessions(session_snapshots(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    return orders.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("name"), F.to_date("o_orderdate").alias("day"), status.alias("status"))


def project_lookup(spark: SparkSession) -> DataFrame:
    return spark.range(20).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("project_ref"), F.concat(F.lit("name"), F.col("id").cast("string")).alias("basename")
    )


def _log(rows: DataFrame, broken: F.Column, blank: F.Column, order: tuple[str, ...] = ()) -> str:
    """``rows`` written as a JSONL log in the shared folder; after each ``broken`` row stands the start of
    its line alone, after each ``blank`` one a line of spaces. Returns the folder."""
    path = f"{storage.shared_folder(rows.sparkSession)}/log-{uuid.uuid4().hex}"
    times = [f.name for f in rows.schema if f.dataType.typeName().startswith("timestamp")]
    line = F.to_json(F.struct(*[dims.iso(c).alias(c) if c in times else F.col(c) for c in rows.columns]))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    lines = F.array_compact(F.array(line, F.when(broken, F.substring(line, 1, 30)), F.when(blank, F.lit("  "))))
    rows.select(F.explode(lines).alias("value")).write.text(path)
    return path


def usage_log(spark: SparkSession, sf_dir: str) -> str:
    """The usage rows as a log with malformed and blank lines."""
    return _log(usage(spark, sf_dir), F.col("output_tokens") % 50 == 0, F.col("output_tokens") % 70 == 0)


def session_log(spark: SparkSession, sf_dir: str) -> str:
    """The session snapshots as a log in the order of time, every tenth of which has no key, with malformed lines."""
    s = session_snapshots(spark, sf_dir).withColumn("snapshot_at", F.date_trunc("hour", "snapshot_at"))
    keyless = F.when(F.col("total_messages") % 10 == 9, F.lit("")).otherwise(F.col("session_key"))
    return _log(s.withColumn("session_key", keyless), F.col("user_messages") % 20 == 3, F.lit(False), ("last_message_at", "total_messages", "session_key"))


def run_log(spark: SparkSession, sf_dir: str) -> str:
    """The runs as a log of one line each; failed ones have a line without a run id besides."""
    r = runs(spark, sf_dir)
    lines = r.select(F.col("name").alias("runId"), "status", F.concat(F.col("day").cast("string"), F.lit("T00:00:00.000Z")).alias("startedAt"))
    broken = lines.where("status = 'failed'").select(F.lit("").alias("runId"), "status", "startedAt")
    return _log(lines.unionByName(broken), F.col("status") == "skipped", F.lit(False))
