"""DuckDB SQL of the logs that the adapter makes of the driver's tables."""

from __future__ import annotations

_MODEL = "CASE (user_id * 3 + event_id) % 7 " + " ".join(
    f"WHEN {i} THEN '{n}'"
    for i, n in enumerate(["claude-opus-4.7", "claude-opus-4.7", "gpt-5.4", "gpt-5.2", "claude-haiku-4.5", "gemini-3-pro-preview", "unknown"])
) + " END"
_RAW = "CASE (user_id * 3 + event_id) % 7 " + " ".join(
    f"WHEN {i} THEN '{n}'"
    for i, n in enumerate(["claude-opus-4-7", "github_copilot/claude-opus-4.7", "gpt-5.4", "gpt-5.2", "Claude Haiku 4.5", "gemini-3-pro-preview", "<synthetic>"])
) + " END"

#: su: usage rows; u: those with tokens; ss: session snapshots; s: sessions; rates.
PRELUDE = f"""
WITH e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
u1 AS (
  SELECT event_id, event_type AS source, {_MODEL} AS model, {_RAW} AS raw_model, 'd' || (user_id % 12) AS device, date_trunc('hour', ts) AS t,
    CASE WHEN event_id % 97 = 0 THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS input,
    CASE WHEN event_id % 97 = 0 THEN 0 ELSE k * 10 END AS cached,
    CASE WHEN event_id % 97 = 0 THEN 0 ELSE (event_id * 7919) % 5000 END AS output,
    CASE WHEN event_id % 97 = 0 OR event_type <> 'purchase' THEN 0 ELSE k END AS reasoning
  FROM e
),
su AS (
  SELECT *, input + cached + output + reasoning AS total, CAST(epoch(t) AS BIGINT) AS sec, CAST(epoch(t) AS BIGINT) // 86400 AS dayno, hour(t) AS hour,
    strftime(t, '%Y-%m-%d') AS day, strftime(t, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, isodow(t) - 1 AS dow
  FROM u1
),
u AS (SELECT * FROM su WHERE total > 0),
sa AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM e),
sb AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sn FROM sa
),
ss AS (
  SELECT concat(user_id, '-', CAST(sn AS BIGINT)) AS session_key, first_value(event_type) OVER w AS source,
    CASE WHEN user_id % 3 = 0 THEN 'agent' ELSE 'human' END AS kind, min(ts) OVER (PARTITION BY user_id, sn) AS started_at, ts AS last_message_at,
    CAST(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', min(ts) OVER (PARTITION BY user_id, sn))) AS BIGINT) AS dur0,
    date_diff('microsecond', min(ts) OVER (PARTITION BY user_id, sn), ts) // 1000000 AS duration_seconds,
    CAST(sum(CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 1 ELSE 0 END) OVER w AS BIGINT) AS user_messages,
    count(*) OVER w AS total_messages, 'p' || (user_id % 25) AS project_ref, {_RAW} AS raw_model, {_MODEL} AS model, ts AS snapshot_at
  FROM sb WINDOW w AS (PARTITION BY user_id, sn ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
),
s AS (
  SELECT *, total_messages - user_messages AS assistant_messages, CAST(epoch(date_trunc('second', started_at)) AS BIGINT) AS start_s,
    CAST(epoch(date_trunc('second', last_message_at)) AS BIGINT) AS last_s, CAST(epoch(date_trunc('second', started_at)) AS BIGINT) // 86400 AS start_day
  FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY snapshot_at DESC, total_messages) AS rn FROM ss) WHERE rn = 1
),
rates(model, ri, rc, ro, rr) AS (VALUES ('claude-opus-4.7', 15.0, 1.5, 75.0, 75.0), ('claude-sonnet-4.6', 3.0, 0.3, 15.0, 15.0), ('gpt-5.4', 5.0, 0.5, 15.0, 15.0), ('gpt-5.2', 2.5, 0.25, 7.5, 7.5), ('gpt-5-nano', 0.2, 0.02, 0.8, 0.8))
"""

_CASTS = {"g": "round(CAST({0} AS DOUBLE), 3) AS {0}", "e": "round(CAST({0} AS DOUBLE), 8) AS {0}", "i": "CAST({0} AS BIGINT) AS {0}", "f": "round(CAST({0} AS DOUBLE), 6) AS {0}", "s": "CAST({0} AS VARCHAR) AS {0}", "b": "CAST({0} AS BOOLEAN) AS {0}"}


def oracle(columns: str, body: str) -> str:
    """SQL of a query. ``body``: more tables after the prelude, the last named out."""
    casts = ", ".join(_CASTS[k].format(f'"{n}"') for n, k in (c.split(":") for c in columns.split()))
    return f"{PRELUDE}, {body.strip()}\nSELECT {casts} FROM out"
