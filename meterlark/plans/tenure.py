"""Queries over tenure and the shape of days."""

from __future__ import annotations

from ..operators import tenure as o
from ..sources import adapter
from .cyclic import sparse
from .registry import AS_OF, COUNTED, COUNTED_COLUMNS, Query

usage = adapter.usage
ISO = "strftime(make_timestamp({0} * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"
DAY = "strftime(make_timestamp({0} * 86400000000), '%Y-%m-%d')"
V = "v AS (SELECT * FROM u WHERE device = 'd3' AND hour % 5 <> 0)"
_T = "key:s first_seen:s last_seen:s span_hours:f active_buckets:i tokens:i tokens_per_active_bucket:f tokens_per_span_hour:f distinct_models:i distinct_sources:i"


def _tn(key: str) -> str:
    return f"""tn AS (SELECT {key} AS key, min(iso) AS first_seen, max(iso) AS last_seen, (max(sec) - min(sec)) / 3600 AS span_hours, count(DISTINCT sec) AS active_buckets, sum(total) AS tokens, sum(total) / count(DISTINCT sec) AS tokens_per_active_bucket,
  sum(total) / greatest((max(sec) - min(sec)) / 3600, 1) AS tokens_per_span_hour, count(DISTINCT model) AS distinct_models, count(DISTINCT source) AS distinct_sources, max(sec) AS b FROM u GROUP BY ALL)"""


_PROVIDER = "CASE WHEN model LIKE 'claude-%' THEN 'anthropic' WHEN model LIKE 'gpt-%' THEN 'openai' WHEN model LIKE 'gemini-%' THEN 'google' ELSE 'unknown' END"
_PD = V + ", pd AS (SELECT day, min(iso) AS first_iso, max(iso) AS last_iso, min(hour) AS fh, max(hour) AS lh, count(DISTINCT sec) AS buckets_on_day, sum(total) AS tokens_on_day FROM v GROUP BY day)"
_SUMMARY = "distinct_days:i total_tokens:i hour_min:i hour_max:i hour_mean:f hour_median:i hour_p25:i hour_p75:i hour_mode:i hour_mode_count:i hour_mode_share:f"


def _round(column: str, q: float) -> str:
    return f"floor(quantile_cont({column}, {q}) + 0.5)"


def _edge(name: str, last: bool) -> list[Query]:
    h, i = ("lh", "last_iso") if last else ("fh", "first_iso")
    return [
        Query(f"{name}_bucket_of_day", "day:s bucket:s hour:i buckets_on_day:i tokens_on_day:i", lambda s, d: o.edge_bucket_of_day(sparse(s, d), last), _PD + f", out AS (SELECT day, {i} AS bucket, {h} AS hour, buckets_on_day, tokens_on_day FROM pd)"),
        Query(f"{name}_bucket_summary", _SUMMARY, lambda s, d: o.edge_bucket_summary(sparse(s, d), last), _PD + f""",
md AS (SELECT {h} AS h, count(*) AS c FROM pd GROUP BY ALL ORDER BY c DESC, h {'DESC' if last else ''} LIMIT 1),
out AS (SELECT count(*) AS distinct_days, sum(tokens_on_day) AS total_tokens, min({h}) AS hour_min, max({h}) AS hour_max, avg({h}) AS hour_mean, {_round(h, .5)} AS hour_median, {_round(h, .25)} AS hour_p25, {_round(h, .75)} AS hour_p75,
  (SELECT h FROM md) AS hour_mode, (SELECT c FROM md) AS hour_mode_count, (SELECT c FROM md) / count(*) AS hour_mode_share FROM pd)"""),
    ]


_SPAN = _PD + ", sp AS (SELECT *, lh - fh + 1 AS span_hours, buckets_on_day / (lh - fh + 1) AS duty_cycle FROM pd)"
_BREADTH = V + ", br AS (SELECT day, count(DISTINCT source) AS source_count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT sec) AS buckets_on_day, sum(total) AS tokens_on_day FROM v GROUP BY day)"
_CUM = """b0 AS (SELECT source, {x} AS x, sum(total) AS t FROM v GROUP BY ALL),
b1 AS (SELECT *, sum(t) OVER (PARTITION BY source) AS al, sum(t) OVER (PARTITION BY source ORDER BY x ROWS UNBOUNDED PRECEDING) AS run FROM b0),
b2 AS (SELECT source, min(x) AS a, max(x) AS b, count(*) AS n, sum(t) AS tokens, min(x) FILTER (run * 2 >= al) AS h FROM b1 GROUP BY source)"""
_DEBUT = V + """, b0 AS (SELECT source, sec, sum(total) AS t FROM v GROUP BY ALL), b1 AS (SELECT *, min(sec) OVER w AS a, max(sec) OVER w AS b FROM b0 WINDOW w AS (PARTITION BY source)),
b2 AS (SELECT source, min(a) AS a, max(b) AS b, count(*) AS active_buckets, sum(t) AS tokens, sum(t) FILTER (sec <= a + (b - a) * 0.25) AS debut_window_tokens FROM b1 GROUP BY source),
b3 AS (SELECT *, max(b) OVER () AS z FROM b2)"""
QUERIES = [
    Query("model_tenure", _T, lambda s, d: o.tenure(usage(s, d), "model"), _tn("model") + ", out AS (SELECT * FROM tn)"),
    Query("provider_tenure", _T, lambda s, d: o.tenure(usage(s, d), "provider"), _tn(_PROVIDER) + ", out AS (SELECT * FROM tn)"),
    Query("source_tenure", _T, lambda s, d: o.tenure(usage(s, d), "source"), _tn("source") + ", out AS (SELECT * FROM tn)"),
    Query("device_tenure", _T + " longest_gap_hours:f hours_since_last_seen:f recently_active:b", lambda s, d: o.device_tenure(usage(s, d), AS_OF * 86400), _tn("device") + f""",
gp AS (SELECT device, max(g) AS longest_gap_hours FROM (SELECT device, (sec - lag(sec) OVER (PARTITION BY device ORDER BY sec)) / 3600 AS g FROM (SELECT DISTINCT device, sec FROM u)) GROUP BY device),
out AS (SELECT tn.*, longest_gap_hours, ({AS_OF * 86400} - b) / 3600 AS hours_since_last_seen, ({AS_OF * 86400} - b) / 3600 < 24 AS recently_active FROM tn JOIN gp ON key = device)"""),
    Query("tenure_density_quadrant", "model:s span_hours:f active_buckets:i tokens:i density:f quadrant:s median_span_hours:f median_density:f", lambda s, d: o.tenure_density_quadrant(usage(s, d)), _tn("model") + """,
md AS (SELECT quantile_cont(span_hours, 0.5) AS ms, quantile_cont(tokens_per_span_hour, 0.5) AS mden FROM tn),
out AS (SELECT key AS model, span_hours, active_buckets, tokens, tokens_per_span_hour AS density, ms AS median_span_hours, mden AS median_density,
  CASE WHEN span_hours >= ms THEN 'long' ELSE 'short' END || '-' || CASE WHEN tokens_per_span_hour >= mden THEN 'dense' ELSE 'sparse' END AS quadrant FROM tn CROSS JOIN md)"""),
    Query("source_decay_half_life", "source:s first_seen:s last_seen:s span_hours:f active_buckets:i tokens:i half_life_iso:s half_life_hours:f half_life_fraction:f front_load_index:f", lambda s, d: o.source_decay_half_life(sparse(s, d)), V + "," + _CUM.format(x="sec") + f""",
out AS (SELECT source, {ISO.format('a')} AS first_seen, {ISO.format('b')} AS last_seen, (b - a) / 3600 AS span_hours, n AS active_buckets, tokens, {ISO.format('h')} AS half_life_iso, (h - a) / 3600 AS half_life_hours, (h - a) / (b - a) AS half_life_fraction, 0.5 - (h - a) / (b - a) AS front_load_index FROM b2)"""),
    Query("cumulative_tokens_midpoint", "source:s tokens:i first_active_day:s last_active_day:s active_days:i tenure_days:i midpoint_day_index:i midpoint_day:s midpoint_pct_tenure:f single_day:b", lambda s, d: o.cumulative_tokens_midpoint(sparse(s, d)), V + "," + _CUM.format(x="dayno") + f""",
out AS (SELECT source, tokens, {DAY.format('a')} AS first_active_day, {DAY.format('b')} AS last_active_day, n AS active_days, b - a + 1 AS tenure_days, h - a AS midpoint_day_index, {DAY.format('h')} AS midpoint_day, (h - a) / (b - a) AS midpoint_pct_tenure, b = a AS single_day FROM b2)"""),
    Query("cumulative_tokens_midpoint_counted", "source:s tokens:i active_days:i midpoint_day:s midpoint_pct_tenure:f" + COUNTED_COLUMNS + "dropped_below_min_days:i dropped_below_midpoint_min:i dropped_above_midpoint_max:i",
          lambda s, d: o.cumulative_tokens_midpoint_counted(usage(s, d), min_days=20, low=0.45, high=0.52, since=COUNTED["since"]), """
w0 AS (SELECT * FROM su WHERE t >= TIMESTAMP '2024-01-05'), v AS (SELECT * FROM w0 WHERE total > 0),
c0 AS (SELECT 0 AS dropped_invalid_hour_start, count(*) FILTER (total <= 0) AS dropped_zero_tokens, 0 AS dropped_source_filter, 0 AS dropped_model_filter FROM w0),""" + _CUM.format(x="dayno") + f""",
m AS (SELECT source, tokens, n AS active_days, {DAY.format('h')} AS midpoint_day, (h - a) / (b - a) AS x FROM b2),
w AS (SELECT *, CASE WHEN active_days < 20 THEN 1 WHEN x < 0.45 THEN 2 WHEN x > 0.52 THEN 3 ELSE 0 END AS why FROM m),
out AS (SELECT c0.*, k.*, y.* EXCLUDE (x), x AS midpoint_pct_tenure FROM c0 CROSS JOIN (SELECT count(*) FILTER (why = 1) AS dropped_below_min_days, count(*) FILTER (why = 2) AS dropped_below_midpoint_min, count(*) FILTER (why = 3) AS dropped_above_midpoint_max FROM w) k
  LEFT JOIN (SELECT * FROM w WHERE why = 0) y ON true)"""),
    Query("source_debut_recency", "source:s first_seen:s last_seen:s tenure_hours:f active_buckets:i tokens:i days_since_debut:f days_since_last_seen:f debut_window_tokens:i debut_share:f", lambda s, d: o.source_debut_recency(sparse(s, d)), _DEBUT + f""",
out AS (SELECT *, {ISO.format('a')} AS first_seen, {ISO.format('b')} AS last_seen, (b - a) / 3600 AS tenure_hours, (z - a) / 86400 AS days_since_debut, (z - b) / 86400 AS days_since_last_seen, debut_window_tokens / tokens AS debut_share FROM b3)"""),
    Query("newcomer_rollup", "newcomer_cutoff:s newcomer_sources:i newcomer_tokens:i newcomer_token_share:f", lambda s, d: o.newcomer_rollup(sparse(s, d), newcomer_days=29), _DEBUT + f""",
out AS (SELECT {ISO.format('(max(z) - 29 * 86400)')} AS newcomer_cutoff, count(*) FILTER (z - a <= 29 * 86400) AS newcomer_sources, coalesce(sum(tokens) FILTER (z - a <= 29 * 86400), 0) AS newcomer_tokens, coalesce(sum(tokens) FILTER (z - a <= 29 * 86400), 0) / sum(tokens) AS newcomer_token_share FROM b3)"""),
    *_edge("first", False), *_edge("last", True),
    Query("active_span_per_day", "day:s first_hour:i last_hour:i span_hours:i active_buckets:i duty_cycle:f tokens_on_day:i", lambda s, d: o.active_span_per_day(sparse(s, d)), _SPAN + ", out AS (SELECT day, fh AS first_hour, lh AS last_hour, span_hours, buckets_on_day AS active_buckets, duty_cycle, tokens_on_day FROM sp)"),
    Query("active_span_summary", "distinct_days:i span_min:i span_max:i span_mean:f span_median:i span_p25:i span_p75:i duty_min:f duty_max:f duty_mean:f duty_median:f duty_p25:f duty_p75:f", lambda s, d: o.active_span_summary(sparse(s, d)), _SPAN + f""",
out AS (SELECT count(*) AS distinct_days, min(span_hours) AS span_min, max(span_hours) AS span_max, avg(span_hours) AS span_mean, {_round('span_hours', .5)} AS span_median, {_round('span_hours', .25)} AS span_p25, {_round('span_hours', .75)} AS span_p75,
  min(duty_cycle) AS duty_min, max(duty_cycle) AS duty_max, avg(duty_cycle) AS duty_mean, quantile_cont(duty_cycle, 0.5) AS duty_median, quantile_cont(duty_cycle, 0.25) AS duty_p25, quantile_cont(duty_cycle, 0.75) AS duty_p75 FROM sp)"""),
    Query("source_breadth_per_day", "day:s source_count:i sources:s buckets_on_day:i tokens_on_day:i", lambda s, d: o.source_breadth_per_day(sparse(s, d)), _BREADTH + ", out AS (SELECT * FROM br)"),
    Query("source_breadth_summary", "distinct_days:i total_tokens:i count_min:i count_max:i count_mean:f count_median:i count_p25:i count_p75:i single_source_days:i multi_source_days:i multi_source_share:f", lambda s, d: o.source_breadth_summary(sparse(s, d)), _BREADTH + f""",
out AS (SELECT count(*) AS distinct_days, sum(tokens_on_day) AS total_tokens, min(source_count) AS count_min, max(source_count) AS count_max, avg(source_count) AS count_mean, {_round('source_count', .5)} AS count_median, {_round('source_count', .25)} AS count_p25,
  {_round('source_count', .75)} AS count_p75, count(*) FILTER (source_count = 1) AS single_source_days, count(*) FILTER (source_count > 1) AS multi_source_days, count(*) FILTER (source_count > 1) / count(*) AS multi_source_share FROM br)"""),
]
