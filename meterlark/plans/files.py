"""Queries that write the logs and exports to files of the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, storage
from ..sources import adapter, logs, scan, sinks
from .registry import Query

_USAGE = (
    "hour_start:s source:s model:s normalised_model:s device_id:s input_tokens:i cached_input_tokens:i output_tokens:i "
    "reasoning_output_tokens:i total_tokens:i usd:e"
)
_SESSIONS = (
    "session_key:s source:s kind:s started_at:s last_message_at:s duration_seconds:i user_messages:i assistant_messages:i "
    "total_messages:i project_ref:s model:s normalised_model:s snapshot_at:s"
)
_EXPORTED_USAGE = """
out AS (SELECT iso AS hour_start, source, raw_model AS model, model AS normalised_model, device AS device_id, input AS input_tokens,
  cached AS cached_input_tokens, output AS output_tokens, reasoning AS reasoning_output_tokens, total AS total_tokens,
  round(coalesce((input * ri + cached * rc + output * ro + reasoning * rr) / 1e6, 0), 8) AS usd FROM su LEFT JOIN rates USING (model))"""
_MS = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%gZ')"
_EXPORTED_SESSIONS = f"""
out AS (SELECT session_key, source, kind, {_MS.format('started_at')} AS started_at, {_MS.format('last_message_at')} AS last_message_at, duration_seconds,
  user_messages, assistant_messages, total_messages, project_ref, raw_model AS model, model AS normalised_model, {_MS.format('snapshot_at')} AS snapshot_at FROM s)"""


def _path(spark: SparkSession) -> str:
    return f"{storage.shared_folder(spark)}/export-{uuid.uuid4().hex}"


def _read_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.read_usage(spark, adapter.usage_log(spark, sf_dir)).withColumn("hour_start", dims.iso("hour_start"))


def _usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scan.counts(logs.scan_usage(spark, adapter.usage_log(spark, sf_dir)))
    return c.agg(F.sum("lines").alias("lines"), F.sum("malformed").alias("malformed"), F.max("first_malformed").isNotNull().alias("malformed_shown"))


def _read_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = logs.latest_sessions(logs.read_session_snapshots(spark, adapter.session_log(spark, sf_dir), position=True))
    return s.withColumns({c: dims.iso(c) for c in ("started_at", "last_message_at", "snapshot_at")})


def _export_usage(kind: str, by: str | None = None):
    def job(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sinks.export(logs.export_usage(adapter.usage(spark, sf_dir), dims.rates(spark)), _path(spark), kind, by)

    return job


def _export_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.export(logs.export_sessions(adapter.sessions(spark, sf_dir)), _path(spark), "csv")


QUERIES = [
    Query("read_usage", "source:s model:s hour_start:s device_id:s input_tokens:i cached_input_tokens:i output_tokens:i reasoning_output_tokens:i total_tokens:i", _read_usage, """
out AS (SELECT source, raw_model AS model, iso AS hour_start, device AS device_id, input AS input_tokens, cached AS cached_input_tokens,
  output AS output_tokens, reasoning AS reasoning_output_tokens, total AS total_tokens FROM su)"""),
    Query("read_usage_counts", "lines:i malformed:i malformed_shown:b", _usage_counts, """
out AS (SELECT count(*) + count(*) FILTER (output % 50 = 0) AS lines, count(*) FILTER (output % 50 = 0) AS malformed, bool_or(output % 50 = 0) AS malformed_shown FROM su)"""),
    Query("read_latest_sessions", "session_key:s source:s kind:s last_message_at:s snapshot_at:s user_messages:i total_messages:i model:s", _read_latest, f"""
k AS (SELECT *, date_trunc('hour', snapshot_at) AS sh FROM ss WHERE total_messages % 10 <> 9),
n AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY sh DESC, last_message_at, total_messages) AS nth FROM k),
out AS (SELECT session_key, source, kind, {_MS.format('last_message_at')} AS last_message_at, {_MS.format('sh')} AS snapshot_at, user_messages, total_messages, raw_model AS model FROM n WHERE nth = 1)"""),
    Query("read_runs", "name:s status:s startedAt:s", lambda s, d: logs.read_runs(s, adapter.run_log(s, d), lines=True), """
out AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS name, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS status,
  strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') AS "startedAt" FROM orders)"""),
    Query("export_usage_csv", _USAGE, _export_usage("csv"), _EXPORTED_USAGE),
    Query("export_usage_ndjson_by_source", _USAGE, _export_usage("ndjson", "source"), _EXPORTED_USAGE),
    Query("export_sessions_csv", _SESSIONS, _export_sessions, _EXPORTED_SESSIONS),
]
