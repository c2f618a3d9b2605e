"""Queries over totals, cost, projects and mixes."""

from __future__ import annotations

from ..functions import dims
from ..operators import totals as t
from ..sources import adapter, logs
from .registry import AS_OF, Query

usage, sessions = adapter.usage, adapter.sessions
_D = "key:s total_tokens:i input_tokens:i output_tokens:i reasoning_tokens:i cached_input_tokens:i events:i"


def _digest(kind: str, key: str) -> Query:
    name = f"digest_{'total' if kind == 'total' else 'by_' + kind}"
    body = f"""out AS (SELECT {key} AS key, sum(total) AS total_tokens, sum(input) AS input_tokens, sum(output) AS output_tokens,
      sum(reasoning) AS reasoning_tokens, sum(cached) AS cached_input_tokens, count(*) AS events FROM su GROUP BY ALL)"""
    return Query(name, _D, lambda s, d: t.digest_by(usage(s, d), kind), body)


def _rates(s):
    return dims.rates(s)


_WEIGHTS = """
w0 AS (SELECT source, last_s // 86400 AS dayno, project_ref, sum(greatest(1, total_messages)) AS w FROM s GROUP BY ALL),
w AS (SELECT *, w / sum(w) OVER (PARTITION BY source, dayno) AS share FROM w0),
tk AS (SELECT source, dayno, sum(total) AS tokens FROM su GROUP BY ALL),
p AS (SELECT project_ref, tk.source, share * tokens AS x FROM tk JOIN w USING (source, dayno))"""
_PRICED = """
c AS (SELECT su.*, r.model AS rm, ri, input * ri / 1e6 AS ci, cached * rc / 1e6 AS cc, output * ro / 1e6 AS co, reasoning * rr / 1e6 AS cr
  FROM su LEFT JOIN rates r ON su.model = r.model)"""
_WEEK = "".join(f", sum(CASE WHEN dow = {i} THEN total ELSE 0 END) AS tokens_{i}" for i in range(7))
_LIST = "[" + ", ".join(f"tokens_{i}" for i in range(7)) + "]"
_COMPARE = "key:s a_tokens:i b_tokens:i a_events:i b_events:i delta:i pct:f t:f hint:s"


def _compare(name: str, which: str, by: str) -> Query:
    (a0, a1), (b0, b1) = t.preset(which, AS_OF - 1)
    body = f"""
g AS (SELECT {by} AS key, dayno, sum(total) AS t, count(*) AS e FROM su WHERE dayno >= {b0} AND dayno < {a1} GROUP BY ALL),
k AS (SELECT DISTINCT key FROM g),
full_days AS (SELECT key, CAST(d AS BIGINT) AS dayno FROM k, range({b0}, {a1}) r(d)),
v AS (SELECT f.key, f.dayno, coalesce(t, 0) AS t, coalesce(e, 0) AS e FROM full_days f LEFT JOIN g USING (key, dayno)),
m AS (SELECT key, sum(t) FILTER (dayno >= {a0}) AS a_tokens, sum(e) FILTER (dayno >= {a0}) AS a_events, avg(t) FILTER (dayno >= {a0}) AS ma, var_samp(t) FILTER (dayno >= {a0}) AS va,
  sum(t) FILTER (dayno < {b1}) AS b_tokens, sum(e) FILTER (dayno < {b1}) AS b_events, avg(t) FILTER (dayno < {b1}) AS mb, var_samp(t) FILTER (dayno < {b1}) AS vb FROM v GROUP BY key),
x AS (SELECT *, CASE WHEN {a1 - a0} < 2 THEN NULL ELSE (ma - mb) / sqrt(va / {a1 - a0} + vb / {b1 - b0}) END AS t FROM m),
out AS (SELECT *, a_tokens - b_tokens AS delta, CASE WHEN b_tokens <> 0 THEN (a_tokens - b_tokens) / b_tokens END AS pct,
  CASE WHEN t IS NULL THEN 'insufficient' WHEN abs(t) >= 1.96 THEN 'significant' WHEN abs(t) >= 1.28 THEN 'weak' ELSE 'n/s' END AS hint FROM x)"""
    return Query(name, _COMPARE, lambda s, d: t.compare_windows(usage(s, d), (a0, a1), (b0, b1), by), body)


QUERIES = [
    _digest("source", "source"), _digest("day", "day"), _digest("model", "model"), _digest("hour", "lpad(CAST(hour AS VARCHAR), 2, '0')"), _digest("total", "'all'"),
    Query("digest_top_pairs", "source:s model:s tokens:i events:i", lambda s, d: t.top_pairs(usage(s, d)),
          "out AS (SELECT source, model, sum(total) AS tokens, count(*) AS events FROM su GROUP BY ALL ORDER BY tokens DESC, source, model LIMIT 15)"),
    Query("digest_top_projects", "project_ref:s sessions:i messages:i", lambda s, d: t.digest_projects(sessions(s, d)),
          "out AS (SELECT project_ref, count(*) AS sessions, sum(total_messages) AS messages FROM s GROUP BY ALL ORDER BY messages DESC, project_ref LIMIT 10)"),
    Query("sources_pivot", "source:s model:s tokens:i source_tokens:i model_tokens:i", lambda s, d: t.sources_pivot(usage(s, d)),
          "g AS (SELECT source, model, sum(total) AS tokens FROM su GROUP BY ALL), out AS (SELECT *, sum(tokens) OVER (PARTITION BY source) AS source_tokens, sum(tokens) OVER (PARTITION BY model) AS model_tokens FROM g)"),
    Query("cost_by_model", "model:s events:i input_tokens:i output_tokens:i reasoning_tokens:i cached_input_tokens:i input_cost:f cached_cost:f output_cost:f reasoning_cost:f total_cost:f blended_rate_per_million:f",
          lambda s, d: t.cost_by_model(usage(s, d), _rates(s)), _PRICED + """,
g AS (SELECT model, count(*) AS events, sum(input) AS input_tokens, sum(output) AS output_tokens, sum(reasoning) AS reasoning_tokens, sum(cached) AS cached_input_tokens,
  sum(ci) AS input_cost, sum(cc) AS cached_cost, sum(co) AS output_cost, sum(cr) AS reasoning_cost, sum(ci + cc + co + cr) AS total_cost FROM c WHERE rm IS NOT NULL GROUP BY ALL),
out AS (SELECT *, total_cost * 1e6 / (input_tokens + output_tokens + reasoning_tokens + cached_input_tokens) AS blended_rate_per_million FROM g)"""),
    Query("cost_summary", "total_cost:f total_cost_no_cache:f cache_savings:f", lambda s, d: t.cost_summary(usage(s, d), _rates(s)), _PRICED + """,
g AS (SELECT sum(ci + cc + co + cr) AS total_cost, sum(ci + cached * ri / 1e6 + co + cr) AS total_cost_no_cache FROM c), out AS (SELECT *, greatest(0, total_cost_no_cache - total_cost) AS cache_savings FROM g)"""),
    Query("cost_unknown_models", "model:s events:i total_tokens:i", lambda s, d: t.cost_unknown_models(usage(s, d), _rates(s)),
          "out AS (SELECT model, count(*) AS events, sum(total) AS total_tokens FROM su WHERE model NOT IN (SELECT model FROM rates) GROUP BY ALL)"),
    Query("project_attribution", "project_ref:s source:s tokens:i", lambda s, d: t.project_attribution(usage(s, d), sessions(s, d)), _WEIGHTS + """,
out AS (SELECT project_ref, source, floor(sum(x) + 0.5) AS tokens FROM p GROUP BY ALL UNION ALL SELECT project_ref, NULL, floor(sum(x) + 0.5) FROM p GROUP BY ALL)"""),
    Query("project_unattributed", "unattributed_tokens:i", lambda s, d: t.project_unattributed(usage(s, d), sessions(s, d)), _WEIGHTS + """,
out AS (SELECT coalesce(sum(tokens), 0) AS unattributed_tokens FROM tk WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.source = tk.source AND w.dayno = tk.dayno))"""),
    Query("top_projects", "rank:i project_ref:s basename:s total_tokens:i share:f", lambda s, d: t.top_projects(usage(s, d), sessions(s, d), adapter.project_lookup(s)), _WEIGHTS + """,
g AS (SELECT project_ref, CAST(floor(sum(x) + 0.5) AS BIGINT) AS total_tokens FROM p GROUP BY ALL),
out AS (SELECT row_number() OVER (ORDER BY total_tokens DESC, project_ref) AS rank, project_ref,
  CASE WHEN CAST(substr(project_ref, 2) AS INT) < 20 THEN 'name' || substr(project_ref, 2) END AS basename, total_tokens, total_tokens / sum(total_tokens) OVER () AS share FROM g QUALIFY rank <= 10)"""),
    Query("agent_mix", "rank:i group:s tokens:i events:i active_hours:i share:f", lambda s, d: t.agent_mix(usage(s, d)), """
g AS (SELECT source AS "group", sum(total) AS tokens, count(*) AS events, count(DISTINCT t) AS active_hours FROM su GROUP BY ALL),
out AS (SELECT *, row_number() OVER (ORDER BY tokens DESC, "group") AS rank, tokens / sum(tokens) OVER () AS share FROM g)"""),
    Query("agent_mix_summary", "total_tokens:i group_count:i hhi:f gini:f top_half_share:f", lambda s, d: t.agent_mix_summary(usage(s, d)), """
g AS (SELECT source, sum(total) AS tokens FROM su GROUP BY ALL),
h AS (SELECT *, tokens / sum(tokens) OVER () AS share, count(*) OVER () AS n, row_number() OVER (ORDER BY tokens DESC, source) AS rk, row_number() OVER (ORDER BY tokens) AS up FROM g),
out AS (SELECT sum(tokens) AS total_tokens, max(n) AS group_count, sum(share * share) AS hhi, sum((2 * up - n - 1) * tokens) / (max(n) * sum(tokens)) AS gini,
  sum(share) FILTER (rk <= ceil(n / 2)) AS top_half_share FROM h)"""),
    Query("device_share", "device_id:s total_tokens:i share:f input_tokens:i cached_input_tokens:i output_tokens:i reasoning_output_tokens:i cache_hit_ratio:f rows:i active_hours:i distinct_models:i distinct_sources:i first_seen:s last_seen:s",
          lambda s, d: t.device_share(usage(s, d)), """
out AS (SELECT device AS device_id, sum(total) AS total_tokens, sum(total) / sum(sum(total)) OVER () AS share, sum(input) AS input_tokens, sum(cached) AS cached_input_tokens, sum(output) AS output_tokens,
  sum(reasoning) AS reasoning_output_tokens, sum(cached) / sum(input) AS cache_hit_ratio, count(*) AS rows, count(DISTINCT t) AS active_hours, count(DISTINCT model) AS distinct_models,
  count(DISTINCT source) AS distinct_sources, min(iso) AS first_seen, max(iso) AS last_seen FROM u GROUP BY device)"""),
    Query("cache_hit_ratio", "model:s source:s rows:i input_tokens:i cached_input_tokens:i hit_ratio:f", lambda s, d: t.cache_hit_ratio(usage(s, d)), """
out AS (SELECT model, source, count(*) AS rows, sum(input) AS input_tokens, sum(cached) AS cached_input_tokens, sum(cached) / sum(input) AS hit_ratio FROM su WHERE input > 0
  GROUP BY GROUPING SETS ((model, source), (model)))"""),
    Query("cache_hit_by_hour", "source:s hour:i input_tokens:i cached_input_tokens:i rows:i cache_ratio:f", lambda s, d: t.cache_hit_by_hour(usage(s, d)), """
h AS (SELECT CAST(x AS BIGINT) AS hour FROM range(24) r(x)), n AS (SELECT DISTINCT source FROM su WHERE input > 0 UNION ALL SELECT NULL),
out AS (SELECT n.source, h.hour, coalesce(sum(input), 0) AS input_tokens, coalesce(sum(least(cached, input)), 0) AS cached_input_tokens, count(su.input) AS rows,
  coalesce(sum(least(cached, input)) / nullif(sum(input), 0), 0) AS cache_ratio FROM n CROSS JOIN h LEFT JOIN su ON su.input > 0 AND su.hour = h.hour AND (n.source IS NULL OR su.source = n.source) GROUP BY ALL)"""),
    Query("cache_hit_extremes", "source:s input_tokens:i cached_input_tokens:i cache_ratio:f peak_hour:i peak_ratio:f trough_hour:i trough_ratio:f spread:f", lambda s, d: t.cache_hit_extremes(usage(s, d)), """
g AS (SELECT source, hour, sum(input) AS i, sum(least(cached, input)) AS c, sum(least(cached, input)) / sum(input) AS r FROM su WHERE input > 0 GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY r DESC, hour) AS p, row_number() OVER (PARTITION BY source ORDER BY r, hour) AS q FROM g),
out AS (SELECT source, sum(i) AS input_tokens, sum(c) AS cached_input_tokens, sum(c) / sum(i) AS cache_ratio, max(hour) FILTER (p = 1) AS peak_hour, max(r) AS peak_ratio,
  max(hour) FILTER (q = 1) AS trough_hour, min(r) AS trough_ratio, max(r) - min(r) AS spread FROM x GROUP BY source)"""),
    Query("reasoning_share", "model:s rows:i output_tokens:i reasoning_tokens:i generated_tokens:i reasoning_share:f", lambda s, d: t.reasoning_share(usage(s, d)), """
out AS (SELECT model, count(*) AS rows, sum(output) AS output_tokens, sum(reasoning) AS reasoning_tokens, sum(output + reasoning) AS generated_tokens, sum(reasoning) / sum(output + reasoning) AS reasoning_share
  FROM su WHERE output + reasoning > 0 GROUP BY ALL)"""),
    Query("output_input_ratio", "model:s rows:i input_tokens:i output_tokens:i ratio:f mean_row_ratio:f", lambda s, d: t.output_input_ratio(usage(s, d)), """
out AS (SELECT model, count(*) AS rows, sum(input) AS input_tokens, sum(output) AS output_tokens, sum(output) / sum(input) AS ratio, avg(output / input) AS mean_row_ratio FROM su WHERE input > 0 GROUP BY ALL)"""),
    Query("output_input_ratio_by_source", "model:s source:s rows:i input_tokens:i output_tokens:i ratio:f mean_row_ratio:f", lambda s, d: t.output_input_ratio(usage(s, d), min_rows=100, by_source=True), """
g AS (SELECT model, source, count(*) AS rows, sum(input) AS input_tokens, sum(output) AS output_tokens, sum(output) / sum(input) AS ratio, avg(output / input) AS mean_row_ratio FROM su WHERE input > 0 GROUP BY GROUPING SETS ((model), (model, source))),
out AS (SELECT * FROM g WHERE model IN (SELECT model FROM g WHERE source IS NULL AND rows >= 100))"""),
    Query("weekday_share", "group:s total_tokens:i " + " ".join(f"tokens_{i}:i" for i in range(7)) + " peak_weekday:i peak_share:f active_weekdays:i hhi:f", lambda s, d: t.weekday_share(usage(s, d)), f"""
g AS (SELECT model AS "group", sum(total) AS total_tokens{_WEEK} FROM u GROUP BY GROUPING SETS ((model), ())),
out AS (SELECT *, list_position({_LIST}, list_max({_LIST})) - 1 AS peak_weekday, list_max({_LIST}) / total_tokens AS peak_share, len(list_filter({_LIST}, lambda x: x > 0)) AS active_weekdays,
  list_sum(list_transform({_LIST}, lambda x: CAST(x AS DOUBLE) * x)) / (CAST(total_tokens AS DOUBLE) * total_tokens) AS hhi FROM g)"""),
    Query("weekend_vs_weekday", "model:s weekend_tokens:i weekday_tokens:i total_tokens:i weekend_share:f weekday_share:f weekend_to_weekday_ratio:f weekend_rows:i weekday_rows:i distinct_sources:i first_seen:s last_seen:s",
          lambda s, d: t.weekend_vs_weekday(usage(s, d)), """
g AS (SELECT model, coalesce(sum(total) FILTER (dow >= 5), 0) AS weekend_tokens, coalesce(sum(total) FILTER (dow < 5), 0) AS weekday_tokens, sum(total) AS total_tokens, count(*) FILTER (dow >= 5) AS weekend_rows,
  count(*) FILTER (dow < 5) AS weekday_rows, count(DISTINCT source) AS distinct_sources, min(iso) AS first_seen, max(iso) AS last_seen FROM u GROUP BY ALL),
out AS (SELECT *, weekend_tokens / total_tokens AS weekend_share, weekday_tokens / total_tokens AS weekday_share, weekend_tokens / weekday_tokens AS weekend_to_weekday_ratio FROM g)"""),
    Query("weekend_vs_weekday_by_source", "model:s source:s weekend_tokens:i weekday_tokens:i total_tokens:i weekend_share:f weekend_to_weekday_ratio:f weekend_rows:i weekday_rows:i distinct_sources:i",
          lambda s, d: t.weekend_vs_weekday(usage(s, d), by_source=True), """
g AS (SELECT model, source, coalesce(sum(total) FILTER (dow >= 5), 0) AS weekend_tokens, coalesce(sum(total) FILTER (dow < 5), 0) AS weekday_tokens, sum(total) AS total_tokens, count(*) FILTER (dow >= 5) AS weekend_rows,
  count(*) FILTER (dow < 5) AS weekday_rows, count(DISTINCT u.source) AS distinct_sources FROM u GROUP BY GROUPING SETS ((model), (model, source))),
out AS (SELECT *, weekend_tokens / total_tokens AS weekend_share, weekend_tokens / weekday_tokens AS weekend_to_weekday_ratio FROM g)"""),
    _compare("compare_wow", "wow", "source"), _compare("compare_dod", "dod", "model"), _compare("compare_rolling_week", "rolling-week", "model"),
    Query("provider_share", "provider:s sessions:i session_share:f messages:i message_share:f distinct_models:i top_models:s", lambda s, d: t.provider_share(sessions(s, d)), """
m AS (SELECT CASE WHEN model LIKE 'claude-%' THEN 'anthropic' WHEN model LIKE 'gpt-%' THEN 'openai' WHEN model LIKE 'gemini-%' THEN 'google' ELSE 'unknown' END AS provider, model, count(*) AS n, sum(total_messages) AS m FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY n DESC, model) AS i FROM m),
out AS (SELECT provider, sum(n) AS sessions, sum(n) / sum(sum(n)) OVER () AS session_share, sum(m) AS messages, sum(m) / sum(sum(m)) OVER () AS message_share, count(*) AS distinct_models,
  string_agg(model || ':' || n, ',' ORDER BY i) FILTER (i <= 3) AS top_models FROM r GROUP BY provider)"""),
    Query("session_source_mix", "bucket:s source:s count:i total_sessions:i unique_sources:i share:f modal_source:s", lambda s, d: t.session_source_mix(sessions(s, d), "week", top=3), """
tp AS (SELECT source FROM s GROUP BY source ORDER BY count(*) DESC, source LIMIT 3),
g AS (SELECT strftime(date_trunc('week', started_at), '%Y-%m-%d') AS bucket, CASE WHEN source IN (SELECT source FROM tp) THEN source ELSE 'other' END AS source, count(*) AS count FROM s GROUP BY ALL),
out AS (SELECT *, sum(count) OVER (PARTITION BY bucket) AS total_sessions, count(*) OVER (PARTITION BY bucket) AS unique_sources, count / sum(count) OVER (PARTITION BY bucket) AS share,
  first_value(source) OVER (PARTITION BY bucket ORDER BY count DESC, source) AS modal_source FROM g)"""),
    Query("export_usage", "hour_start:s source:s model:s normalised_model:s device_id:s input_tokens:i cached_input_tokens:i output_tokens:i reasoning_output_tokens:i total_tokens:i usd:e",
          lambda s, d: logs.export_usage(usage(s, d), _rates(s), source="CLICK"), _PRICED + """,
out AS (SELECT iso AS hour_start, source, raw_model AS model, model AS normalised_model, device AS device_id, input AS input_tokens, cached AS cached_input_tokens, output AS output_tokens, reasoning AS reasoning_output_tokens,
  total AS total_tokens, round(coalesce(ci + cc + co + cr, 0), 8) AS usd FROM c WHERE source LIKE '%click%')"""),
    Query("export_sessions", "session_key:s source:s kind:s started_at:s last_message_at:s duration_seconds:i user_messages:i assistant_messages:i total_messages:i project_ref:s model:s normalised_model:s snapshot_at:s",
          lambda s, d: logs.export_sessions(sessions(s, d)), """
f AS (SELECT *, strftime(started_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS a, strftime(last_message_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS b FROM s),
out AS (SELECT session_key, source, kind, a AS started_at, b AS last_message_at, duration_seconds, user_messages, assistant_messages, total_messages, project_ref, raw_model AS model, model AS normalised_model, b AS snapshot_at FROM f)"""),
    Query("latest_sessions", "session_key:s source:s kind:s duration_seconds:i user_messages:i total_messages:i project_ref:s model:s", lambda s, d: sessions(s, d),
          "out AS (SELECT session_key, source, kind, duration_seconds, user_messages, total_messages, project_ref, raw_model AS model FROM s)"),
]
