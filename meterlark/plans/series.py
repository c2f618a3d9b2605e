"""Queries over series of days and hours. Those about gaps run on rows with gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import series as o
from ..sources import adapter
from .cyclic import sparse
from .registry import AS_OF, COUNTED, COUNTED_COLUMNS, COUNTED_SQL, Query
from .tenure import DAY, ISO, V

usage = adapter.usage
NOW = AS_OF * 86400
DAY1 = AS_OF - 1  # the last day with rows
MONTH = 19723  # 2024-01-01


def rare(s, d):
    """Usage of one device in three hours of the day, so that days without tokens occur."""
    return usage(s, d).where((F.col("device_id") == "d3") & (F.hour("hour_start") % 8 == 3))


R = "v AS (SELECT * FROM u WHERE device = 'd3' AND hour % 8 = 3)"


def _days(end: int, n: int) -> str:
    return f"""dg AS (SELECT CAST(x AS BIGINT) AS dayno FROM range({end - n + 1}, {end + 1}) r(x)),
ds AS (SELECT dg.dayno, {DAY.format('dg.dayno')} AS day, coalesce(sum(total), 0) AS tokens, count(total) AS events, coalesce(sum(input), 0) AS input_tokens, coalesce(sum(cached), 0) AS cached_input_tokens FROM dg LEFT JOIN su ON su.dayno = dg.dayno GROUP BY dg.dayno)"""


_FIT = _days(DAY1, 14) + f""", fx AS (SELECT dayno - {DAY1 - 13} AS x, tokens AS y FROM ds),
ft AS (SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_sxx(y, x) AS sxx, regr_r2(y, x) AS r2, sum(y) AS total FROM fx),
fe AS (SELECT ft.*, (SELECT sum((y - slope * x - intercept) ** 2) FROM fx) AS sse FROM ft)"""
_SUNDAY = DAY1 + 6 - (DAY1 + 3) % 7
_POINTS = _FIT + f""", px AS (SELECT CAST(q AS BIGINT) AS dayno, 13 + q - {DAY1} AS x FROM range({DAY1 + 1}, {max(DAY1 + 1, _SUNDAY) + 1}) r(q)),
pt AS (SELECT dayno, intercept + slope * x AS predicted, 1.96 * sqrt(sse / (n - 2)) * sqrt(1 + 1 / n + (x - 6.5) ** 2 / sxx) AS half FROM px CROSS JOIN fe)"""
_USD = "cu AS (SELECT su.*, coalesce(input * ri + cached * rc + output * ro + reasoning * rr, 0) / 1e6 AS usd FROM su LEFT JOIN rates r ON r.model = su.model)"


def _anomaly(end: int) -> str:
    return _days(end, 37) + f""", an0 AS (SELECT *, avg(tokens) OVER w AS baseline_mean, stddev_samp(tokens) OVER w AS baseline_std_dev FROM ds WINDOW w AS (ORDER BY dayno ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
an AS (SELECT *, (tokens - baseline_mean) / nullif(baseline_std_dev, 0) AS z FROM an0 WHERE dayno > {end - 30}),
ans AS (SELECT *, CASE WHEN z IS NULL THEN 'flat' WHEN z >= 2 THEN 'high' WHEN z <= -2 THEN 'low' ELSE 'normal' END AS status FROM an)"""


def _drift(end: int) -> str:
    """The smoothed value by its closed form over the numbered defined days."""
    return f"""dq AS (SELECT CAST(x AS BIGINT) AS dayno FROM range({end - 29}, {end + 1}) r(x)),
d0 AS (SELECT dq.dayno, {DAY.format('dq.dayno')} AS day, coalesce(sum(input), 0) AS i, coalesce(sum(cached), 0) AS c FROM dq LEFT JOIN su ON su.dayno = dq.dayno GROUP BY dq.dayno),
d1 AS (SELECT *, c / nullif(i + c, 0) AS ratio FROM d0),
d2 AS (SELECT *, ln(least(greatest(ratio, 1e-6), 1 - 1e-6) / (1 - least(greatest(ratio, 1e-6), 1 - 1e-6))) AS x, count(ratio) OVER (ORDER BY dayno) - 1 AS k FROM d1),
d3 AS (SELECT a.dayno, a.day, a.ratio, a.i, a.c, sum(CASE WHEN b.k = 0 THEN 1 ELSE 0.3 END * 0.7 ** (a.k - b.k) * b.x) AS logit FROM d2 a LEFT JOIN d2 b ON b.ratio IS NOT NULL AND b.k <= a.k GROUP BY ALL),
d4 AS (SELECT *, 1 / (1 + exp(-logit)) AS ewma, CASE WHEN ratio IS NOT NULL AND count(logit) OVER w = 7 THEN avg(logit) OVER w END AS mu, CASE WHEN ratio IS NOT NULL AND count(logit) OVER w = 7 THEN stddev_samp(logit) OVER w END AS sg FROM d3 WINDOW w AS (ORDER BY dayno ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
d5 AS (SELECT *, CASE WHEN sg >= 1e-9 THEN (logit - mu) / sg END AS z FROM d4),
dr AS (SELECT *, CASE WHEN ratio IS NULL THEN 'undefined' WHEN sg IS NULL THEN 'warmup' WHEN z IS NULL THEN 'flat' WHEN z >= 2 THEN 'high' WHEN z <= -2 THEN 'low' ELSE 'normal' END AS status FROM d5)"""


_STREAK = _days(AS_OF, 30) + """, sk0 AS (SELECT *, CASE WHEN tokens >= 1 THEN 'active' ELSE 'idle' END AS state FROM ds),
sk1 AS (SELECT *, dayno - row_number() OVER (PARTITION BY state ORDER BY dayno) AS g FROM sk0),
sk AS (SELECT state, min(day) AS start_day, max(day) AS end_day, count(*) AS length, sum(tokens) AS tokens FROM sk1 GROUP BY state, g)"""
_VEL = f"""vh AS (SELECT sec // 3600 AS h, sum(total) AS tokens, sum(input) AS input_tokens, sum(output) AS output_tokens, count(*) AS events FROM su WHERE device = 'd3' AND hour % 5 <> 0 AND sec // 3600 BETWEEN {NOW // 3600 - 167} AND {NOW // 3600} GROUP BY ALL HAVING sum(total) >= 1),
vg AS (SELECT *, h - row_number() OVER (ORDER BY h) AS g FROM vh),
vs AS (SELECT min(h) AS a, max(h) AS b, count(*) AS hours, sum(tokens) AS tokens, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(events) AS events, sum(tokens) / (count(*) * 60) AS tokens_per_minute FROM vg GROUP BY g)"""
_GAPS = V + ", gb AS (SELECT source, sec, sum(total) AS t FROM v GROUP BY ALL), gg AS (SELECT *, (sec - lag(sec) OVER (PARTITION BY source ORDER BY sec)) // 3600 AS g FROM gb)"
_DAILY = R + ", dy AS (SELECT source, dayno, sum(total) AS t FROM v GROUP BY ALL)"
_RUNS = _DAILY + ", dr0 AS (SELECT *, dayno - row_number() OVER (PARTITION BY source ORDER BY dayno) AS g FROM dy), rn AS (SELECT source, g, count(*) AS n, min(dayno) AS a, max(dayno) AS b, sum(t) AS t FROM dr0 GROUP BY ALL)"


def _signs(expr: str, lag: int) -> str:
    """Runs of an expression's sign: rn2(source, s, steps, a, b, last)."""
    return _DAILY + f""", sg0 AS (SELECT source, dayno, t, lag(t) OVER w AS p, lag(t, 2) OVER w AS pp, lag(dayno, {lag}) OVER w AS d0, row_number() OVER w AS i FROM dy WINDOW w AS (PARTITION BY source ORDER BY dayno)),
sg1 AS (SELECT source, dayno, d0, i, sign({expr}) AS s FROM sg0 WHERE d0 IS NOT NULL),
sg2 AS (SELECT *, i - row_number() OVER (PARTITION BY source, s ORDER BY i) AS g, max(i) OVER (PARTITION BY source) AS mi FROM sg1),
rn2 AS (SELECT source, s, count(*) AS steps, min(d0) AS a, max(dayno) AS b, min(i) AS i0, max(i) = max(mi) AS last FROM sg2 GROUP BY source, s, g)"""


def _best(s: int, name: str, plus: int) -> str:
    w = f"FILTER (s = {s})"
    return (f"coalesce(max(steps) {w} + {plus}, 0) AS longest_{name}_run, {DAY.format(f'(arg_min(a, (-steps, i0)) {w})')} AS longest_{name}_start, {DAY.format(f'(arg_min(b, (-steps, i0)) {w})')} AS longest_{name}_end")


_RANK = R + """, rk0 AS (SELECT source, dayno, sum(total) AS t FROM v GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY dayno ORDER BY t DESC, source) AS rank FROM rk0),
rp0 AS (SELECT DISTINCT a.dayno AS d FROM rk a JOIN rk b ON b.dayno = a.dayno + 1), rp1 AS (SELECT d, source, max(CASE WHEN dayno = d THEN rank END) AS ra, max(CASE WHEN dayno = d + 1 THEN rank END) AS rb FROM rp0 JOIN rk ON dayno IN (d, d + 1) GROUP BY ALL),
rp2 AS (SELECT d, count(*) AS n FROM rp1 GROUP BY d), rp AS (SELECT d, n, sum(abs(coalesce(ra, n) - coalesce(rb, n))) / floor(n * n / 2) AS footrule FROM rp1 JOIN rp2 USING (d) WHERE n >= 2 GROUP BY d, n)"""
_SR = "source:s total_tokens:i n_active_days:i"

QUERIES = [
    Query("daily_series", "day:s tokens:i events:i", lambda s, d: o.daily_series(usage(s, d), AS_OF, 40), _days(AS_OF, 40) + ", out AS (SELECT * FROM ds)"),
    Query("trend_deltas", "period:s current:i previous:i delta:i pct:f", lambda s, d: o.trend_deltas(usage(s, d), NOW), f"""
w AS (SELECT * FROM (VALUES ('day', 86400), ('week', 604800)) q(period, n)),
x AS (SELECT period, coalesce(sum(total) FILTER (sec >= {NOW} - n), 0) AS current, coalesce(sum(total) FILTER (sec < {NOW} - n), 0) AS previous FROM w LEFT JOIN su ON sec >= {NOW} - 2 * n AND sec < {NOW} GROUP BY period),
out AS (SELECT *, current - previous AS delta, (current - previous) / nullif(previous, 0) AS pct FROM x)"""),
    Query("trend_by_model", "model:s current:i previous:i delta:i pct:f series:s", lambda s, d: o.trend_by_model(usage(s, d), NOW), f"""
g AS (SELECT model, dayno, sum(total) AS t FROM su WHERE sec >= {NOW - 14 * 86400} AND sec < {NOW} GROUP BY ALL), m AS (SELECT DISTINCT model FROM g),
f AS (SELECT m.model, CAST(x AS BIGINT) AS dayno, coalesce(t, 0) AS t FROM m CROSS JOIN range({AS_OF - 14}, {AS_OF + 1}) r(x) LEFT JOIN g ON g.model = m.model AND g.dayno = x),
h AS (SELECT model, sum(t) FILTER (dayno >= {AS_OF - 7}) AS current, sum(t) FILTER (dayno < {AS_OF - 7}) AS previous, string_agg(CAST(CAST(t AS BIGINT) AS VARCHAR), ',' ORDER BY dayno) FILTER (dayno > {AS_OF - 14}) AS series FROM f GROUP BY model),
out AS (SELECT *, current - previous AS delta, (current - previous) / nullif(previous, 0) AS pct FROM h ORDER BY current DESC, model LIMIT 8)"""),
    Query("forecast_fit", "n:i slope:f intercept:f r2:f residual_std_err:f low_confidence:b", lambda s, d: o.forecast_fit(usage(s, d), DAY1), _FIT + ", out AS (SELECT n, slope, intercept, r2, sqrt(sse / (n - 2)) AS residual_std_err, n < 4 OR total = 0 AS low_confidence FROM fe)"),
    Query("forecast_points", "day:s predicted:g lower:g upper:g in_week:b", lambda s, d: o.forecast_points(usage(s, d), DAY1), _POINTS + f", out AS (SELECT {DAY.format('dayno')} AS day, predicted, greatest(0, predicted - half) AS lower, predicted + half AS upper, dayno <= {_SUNDAY} AS in_week FROM pt)"),
    Query("forecast_week", "week_observed:i week_projected:g week_projected_lower:g week_projected_upper:g", lambda s, d: o.forecast_week(usage(s, d), DAY1 * 86400 + 86399), _POINTS + f""",
wo AS (SELECT sum(total) AS w FROM su WHERE dayno BETWEEN {DAY1 - (DAY1 + 3) % 7} AND {DAY1}),
out AS (SELECT w AS week_observed, w + (SELECT sum(predicted) FROM pt WHERE dayno <= {_SUNDAY}) AS week_projected, w + (SELECT sum(greatest(0, predicted - half)) FROM pt WHERE dayno <= {_SUNDAY}) AS week_projected_lower, w + (SELECT sum(predicted + half) FROM pt WHERE dayno <= {_SUNDAY}) AS week_projected_upper FROM wo)"""),
    Query("budget_daily", "day:s usd:e", lambda s, d: o.budget_daily(usage(s, d), dims.rates(s), NOW), _USD + f""",
out AS (SELECT {DAY.format('CAST(x AS BIGINT)')} AS day, coalesce(sum(usd), 0) AS usd FROM range({AS_OF - 6}, {AS_OF + 1}) r(x) LEFT JOIN cu ON dayno = x AND sec >= {NOW - 7 * 86400} AND sec < {NOW} GROUP BY x)"""),
    Query("budget_status", "month_spend_usd:e today_spend_usd:e daily_burn_usd:f monthly_budget_usd:f percent_of_month_budget_used:f days_remaining_in_month:i eta_breach_day:s status:s", lambda s, d: o.budget_status(usage(s, d), dims.rates(s), NOW - 10 * 86400 + 43200, 31.0), _USD + f""",
a AS (SELECT coalesce(sum(usd) FILTER (dayno >= {MONTH}), 0) AS month_spend_usd, coalesce(sum(usd) FILTER (dayno = {AS_OF - 10}), 0) AS today_spend_usd, coalesce(sum(usd) FILTER (sec >= {NOW - 17 * 86400 + 43200}), 0) / 7 AS daily_burn_usd FROM cu WHERE sec < {NOW - 10 * 86400 + 43200}),
b AS (SELECT *, 31.0 * 31 AS monthly_budget_usd, ceil((961 - month_spend_usd) / daily_burn_usd) AS k, {AS_OF - 10 - MONTH + 1} AS td, today_spend_usd / 31.0 AS r FROM a),
out AS (SELECT *, month_spend_usd / 961 AS percent_of_month_budget_used, 31 - td + 1 AS days_remaining_in_month, CASE WHEN month_spend_usd < 961 AND k <= 31 - td THEN {DAY.format(f'CAST({AS_OF - 10} + k AS BIGINT)')} END AS eta_breach_day,
  CASE WHEN month_spend_usd >= 961 THEN 'breached' WHEN r >= 1.5 THEN 'breached' WHEN r >= 1 THEN 'over' WHEN r >= 0.8 THEN 'on-track' ELSE 'under' END AS status FROM b)"""),
    Query("anomalies", "day:s tokens:i baseline_mean:f baseline_std_dev:f z:f status:s", lambda s, d: o.anomalies(usage(s, d), AS_OF), _anomaly(AS_OF) + ", out AS (SELECT * FROM ans)"),
    Query("cache_ratio_drift", "day:s ratio:f input_tokens:i cached_input_tokens:i ewma:f baseline_logit_mean:f baseline_logit_std_dev:f z:f status:s", lambda s, d: o.cache_ratio_drift(usage(s, d), AS_OF), _drift(AS_OF) + ", out AS (SELECT day, ratio, i AS input_tokens, c AS cached_input_tokens, ewma, mu AS baseline_logit_mean, sg AS baseline_logit_std_dev, z, status FROM dr)"),
    Query("dashboard_drift", "token_status:s ratio_status:s token_drift_pct:f ratio_drift_pct_points:f alerting:b", lambda s, d: o.dashboard_drift(usage(s, d), DAY1), _anomaly(DAY1) + "," + _drift(DAY1) + f""",
ta AS (SELECT * FROM ans WHERE dayno = {DAY1}), ra AS (SELECT * FROM dr ORDER BY mu IS NULL, dayno DESC LIMIT 1),
out AS (SELECT ta.status AS token_status, ra.status AS ratio_status, CASE WHEN ta.status <> 'flat' THEN (tokens - baseline_mean) / nullif(baseline_mean, 0) * 100 END AS token_drift_pct,
  CASE WHEN ra.status IN ('high', 'low', 'normal') THEN (ewma - 1 / (1 + exp(-mu))) * 100 END AS ratio_drift_pct_points, ta.status = 'high' OR ra.status IN ('high', 'low') AS alerting FROM ta CROSS JOIN ra)"""),
    Query("activity_streaks", "state:s start_day:s end_day:s length:i tokens:i", lambda s, d: o.activity_streaks(usage(s, d), AS_OF), _STREAK + ", out AS (SELECT * FROM sk)"),
    Query("activity_streak_summary", "active_days:i idle_days:i active_fraction:f active_run_count:i median_active_length:f mean_active_length:f longest_active:i longest_active_start:s longest_idle:i longest_idle_start:s current_state:s current_length:i", lambda s, d: o.activity_streak_summary(usage(s, d), AS_OF), _STREAK + """,
out AS (SELECT sum(length) FILTER (state = 'active') AS active_days, sum(length) FILTER (state = 'idle') AS idle_days, sum(length) FILTER (state = 'active') / 30 AS active_fraction, count(*) FILTER (state = 'active') AS active_run_count,
  quantile_cont(length, 0.5) FILTER (state = 'active') AS median_active_length, avg(length) FILTER (state = 'active') AS mean_active_length, max(length) FILTER (state = 'active') AS longest_active, arg_min(start_day, (-length, start_day)) FILTER (state = 'active') AS longest_active_start,
  max(length) FILTER (state = 'idle') AS longest_idle, arg_min(start_day, (-length, start_day)) FILTER (state = 'idle') AS longest_idle_start, arg_max(state, end_day) AS current_state, arg_max(length, end_day) AS current_length FROM sk)"""),
    Query("velocity_stretches", "start_hour:s end_hour:s hours:i tokens:i input_tokens:i output_tokens:i events:i tokens_per_minute:f idle_hours_before:i", lambda s, d: o.velocity_stretches(sparse(s, d), NOW), _VEL + f""",
out AS (SELECT *, {ISO.format('(a * 3600)')} AS start_hour, {ISO.format('(b * 3600)')} AS end_hour, a - coalesce(lag(b) OVER (ORDER BY a), {NOW // 3600 - 168}) - 1 AS idle_hours_before FROM vs)"""),
    Query("velocity_summary", "total_active_hours:i stretch_count:i total_active_tokens:i average_tokens_per_minute:f median_tokens_per_minute:f peak_start:s longest_start:s longest_hours:i", lambda s, d: o.velocity_summary(sparse(s, d), NOW), _VEL + f""",
out AS (SELECT sum(hours) AS total_active_hours, count(*) AS stretch_count, sum(tokens) AS total_active_tokens, sum(tokens) / (sum(hours) * 60) AS average_tokens_per_minute, quantile_cont(tokens_per_minute, 0.5) AS median_tokens_per_minute,
  {ISO.format('(arg_min(a, (-tokens_per_minute, -hours, a)) * 3600)')} AS peak_start, {ISO.format('(arg_min(a, (-hours, -tokens_per_minute, a)) * 3600)')} AS longest_start, max(hours) AS longest_hours FROM vs)"""),
    Query("bucket_streak_length", "model:s active_buckets:i streak_count:i longest_streak:i mean_streak_length:f longest_streak_start:s longest_streak_end:s tokens:i", lambda s, d: o.bucket_streak_length(sparse(s, d)), V + f""",
b AS (SELECT model, sec, sum(total) AS t FROM v GROUP BY ALL), g AS (SELECT *, sec // 3600 - row_number() OVER (PARTITION BY model ORDER BY sec) AS g FROM b),
r AS (SELECT model, count(*) AS n, min(sec) AS a, max(sec) AS z, sum(t) AS t FROM g GROUP BY model, g),
out AS (SELECT model, sum(n) AS active_buckets, count(*) AS streak_count, max(n) AS longest_streak, avg(n) AS mean_streak_length, {ISO.format('(arg_min(a, (-n, a)))')} AS longest_streak_start, {ISO.format('(arg_min(z, (-n, a)))')} AS longest_streak_end, sum(t) AS tokens FROM r GROUP BY model)"""),
    Query("bucket_streak_length_counted", "model:s active_buckets:i streak_count:i longest_streak:i longest_streak_start:s tokens:i" + COUNTED_COLUMNS + "dropped_below_min_buckets:i",
          lambda s, d: o.bucket_streak_length_counted(usage(s, d), min_buckets=220, **COUNTED), COUNTED_SQL + f""",
b AS (SELECT model, sec, sum(total) AS t FROM v GROUP BY ALL), g AS (SELECT *, sec // 3600 - row_number() OVER (PARTITION BY model ORDER BY sec) AS g FROM b),
r AS (SELECT model, count(*) AS n, min(sec) AS a, sum(t) AS t FROM g GROUP BY model, g),
m AS (SELECT model, sum(n) AS active_buckets, count(*) AS streak_count, max(n) AS longest_streak, {ISO.format('(arg_min(a, (-n, a)))')} AS longest_streak_start, sum(t) AS tokens FROM r GROUP BY model),
out AS (SELECT * FROM c0 CROSS JOIN (SELECT count(*) FILTER (active_buckets < 220) AS dropped_below_min_buckets FROM m) LEFT JOIN (SELECT * FROM m WHERE active_buckets >= 220) ON true)"""),
    Query("bucket_gap_distribution", "source:s active_buckets:i gap_count:i min_gap:i p50_gap:i p90_gap:i p99_gap:i max_gap:i mean_gap:f contiguous_gaps:i contiguous_share:f tokens:i", lambda s, d: o.bucket_gap_distribution(sparse(s, d)), _GAPS + """,
out AS (SELECT source, count(*) AS active_buckets, count(g) AS gap_count, min(g) AS min_gap, quantile_disc(g, 0.5) AS p50_gap, quantile_disc(g, 0.9) AS p90_gap, quantile_disc(g, 0.99) AS p99_gap, max(g) AS max_gap, avg(g) AS mean_gap,
  count(*) FILTER (g = 1) AS contiguous_gaps, count(*) FILTER (g = 1) / count(g) AS contiguous_share, sum(t) AS tokens FROM gg GROUP BY source)"""),
    Query("interarrival_time", "source:s active_buckets:i gap_count:i min_hours:i max_hours:i sum_hours:i p50_hours:i p90_hours:i mean_hours:f " + " ".join(f"from_{e}h:i" for e in o.GAP_EDGES), lambda s, d: o.interarrival_time(sparse(s, d)), _GAPS + """,
out AS (SELECT source, count(*) AS active_buckets, count(g) AS gap_count, min(g) AS min_hours, max(g) AS max_hours, sum(g) AS sum_hours, quantile_disc(g, 0.5) AS p50_hours, quantile_disc(g, 0.9) AS p90_hours, avg(g) AS mean_hours, """
          + ", ".join(f"count(*) FILTER (g >= {lo}{f' AND g < {hi}' if hi else ''}) AS from_{lo}h" for lo, hi in zip(o.GAP_EDGES, [*o.GAP_EDGES[1:], None], strict=True)) + " FROM gg GROUP BY source)"),
    Query("source_active_day_streak", "source:s first_day:s last_day:s tenure_days:i active_days:i streaks:i mean_streak:f longest_streak:i longest_streak_start:s longest_streak_end:s current_streak:i density:f tokens:i", lambda s, d: o.source_active_day_streak(rare(s, d)), _RUNS + f""",
out AS (SELECT source, {DAY.format('min(a)')} AS first_day, {DAY.format('max(b)')} AS last_day, max(b) - min(a) + 1 AS tenure_days, sum(n) AS active_days, count(*) AS streaks, avg(n) AS mean_streak, max(n) AS longest_streak, {DAY.format('arg_min(a, (-n, a))')} AS longest_streak_start,
  {DAY.format('arg_min(b, (-n, a))')} AS longest_streak_end, arg_max(n, b) AS current_streak, sum(n) / (max(b) - min(a) + 1) AS density, sum(t) AS tokens FROM rn GROUP BY source)"""),
    Query("source_dry_spell", "source:s first_day:s last_day:s tenure_days:i active_days:i inactive_days:i longest_dry_spell:i longest_dry_spell_start:s longest_dry_spell_end:s n_dry_spells:i mean_dry_spell:f dry_spell_fraction:f tokens:i", lambda s, d: o.source_dry_spell(rare(s, d)), _RUNS + f""",
q AS (SELECT *, lead(a) OVER (PARTITION BY source ORDER BY a) - b - 1 AS gap FROM rn),
out AS (SELECT source, {DAY.format('min(a)')} AS first_day, {DAY.format('max(b)')} AS last_day, max(b) - min(a) + 1 AS tenure_days, sum(n) AS active_days, max(b) - min(a) + 1 - sum(n) AS inactive_days, coalesce(max(gap), 0) AS longest_dry_spell,
  {DAY.format('(arg_min(b + 1, (-gap, b)) FILTER (gap > 0))')} AS longest_dry_spell_start, {DAY.format('(arg_min(b + gap, (-gap, b)) FILTER (gap > 0))')} AS longest_dry_spell_end, count(gap) AS n_dry_spells, coalesce(avg(gap), 0) AS mean_dry_spell,
  (max(b) - min(a) + 1 - sum(n)) / (max(b) - min(a) + 1) AS dry_spell_fraction, sum(t) AS tokens FROM q GROUP BY source)"""),
    Query("daily_zscore_extremes", _SR + " mean:f stddev:f flat:b n_high_extreme:i n_low_extreme:i n_extreme:i extreme_fraction:f max_abs_z:f max_abs_z_day:s max_abs_z_tokens:i max_abs_z_direction:s first_active_day:s last_active_day:s", lambda s, d: o.daily_zscore_extremes(rare(s, d)), _DAILY + f""",
m AS (SELECT *, avg(t) OVER w AS mu, stddev_pop(t) OVER w AS sg FROM dy WINDOW w AS (PARTITION BY source)), z AS (SELECT *, coalesce((t - mu) / nullif(sg, 0), 0) AS z FROM m),
out AS (SELECT source, sum(t) AS total_tokens, count(*) AS n_active_days, any_value(mu) AS mean, any_value(sg) AS stddev, any_value(sg) = 0 AS flat, count(*) FILTER (z > 2) AS n_high_extreme, count(*) FILTER (z < -2) AS n_low_extreme, count(*) FILTER (abs(z) > 2) AS n_extreme, count(*) FILTER (abs(z) > 2) / count(*) AS extreme_fraction,
  max(abs(z)) AS max_abs_z, {DAY.format('arg_min(dayno, (-round(abs(z), 12), dayno))')} AS max_abs_z_day, arg_min(t, (-round(abs(z), 12), dayno)) AS max_abs_z_tokens, CASE WHEN arg_min(z, (-round(abs(z), 12), dayno)) >= 0 THEN 'high' ELSE 'low' END AS max_abs_z_direction, {DAY.format('min(dayno)')} AS first_active_day, {DAY.format('max(dayno)')} AS last_active_day FROM z GROUP BY source HAVING count(*) >= 3)"""),
    Query("daily_autocorr_lag1", _SR + " n_filled_days:i mean:f stddev:f rho1_active:f flat_active:b rho1_filled:f flat_filled:b first_active_day:s last_active_day:s", lambda s, d: o.daily_autocorr_lag1(rare(s, d)), _DAILY + f""",
b AS (SELECT source, min(dayno) AS a, max(dayno) AS z FROM dy GROUP BY source), fl AS (SELECT b.source, CAST(x AS BIGINT) AS dayno, coalesce(t, 0) AS t FROM b JOIN range(19000, 21000) r(x) ON x BETWEEN a AND z LEFT JOIN dy ON dy.source = b.source AND dy.dayno = x),
c AS (SELECT source, dayno, t - avg(t) OVER (PARTITION BY source) AS x, t, lead(t) OVER (PARTITION BY source ORDER BY dayno) - avg(t) OVER (PARTITION BY source) AS y FROM dy), cf AS (SELECT source, t - avg(t) OVER (PARTITION BY source) AS x, lead(t) OVER (PARTITION BY source ORDER BY dayno) - avg(t) OVER (PARTITION BY source) AS y FROM fl),
f AS (SELECT source, sum(x * y) / sum(x * x) AS rf, count(*) AS n FROM cf GROUP BY source),
out AS (SELECT c.source, sum(t) AS total_tokens, count(*) AS n_active_days, any_value(f.n) AS n_filled_days, avg(t) AS mean, stddev_pop(t) AS stddev, sum(x * y) / sum(x * x) AS rho1_active, false AS flat_active, any_value(rf) AS rho1_filled, false AS flat_filled, {DAY.format('min(dayno)')} AS first_active_day, {DAY.format('max(dayno)')} AS last_active_day FROM c JOIN f USING (source) GROUP BY c.source HAVING count(*) >= 3)"""),
    Query("daily_monotone_runs", _SR + " longest_up_run:i longest_up_start:s longest_up_end:s longest_down_run:i longest_down_start:s longest_down_end:s longest_monotone_run:i longest_direction:s current_direction:s current_run_length:i runs:i first_active_day:s last_active_day:s", lambda s, d: o.daily_monotone_runs(rare(s, d)), _signs("t - p", 1) + f""",
q AS (SELECT source, {_best(1, 'up', 1)}, {_best(-1, 'down', 1)}, max(CASE WHEN last THEN s END) AS cs, max(CASE WHEN last THEN steps END) + 1 AS cn, count(*) FILTER (s <> 0) AS runs FROM rn2 GROUP BY source),
out AS (SELECT q.*, total_tokens, n_active_days, greatest(longest_up_run, longest_down_run) AS longest_monotone_run, CASE WHEN longest_up_run >= longest_down_run THEN 'up' ELSE 'down' END AS longest_direction, CASE cs WHEN 1 THEN 'up' WHEN -1 THEN 'down' ELSE 'flat' END AS current_direction, cn AS current_run_length,
  {DAY.format('a')} AS first_active_day, {DAY.format('z')} AS last_active_day FROM q JOIN (SELECT source, sum(t) AS total_tokens, count(*) AS n_active_days, min(dayno) AS a, max(dayno) AS z FROM dy GROUP BY source) USING (source))"""),
    Query("daily_second_diff_runs", _SR + " n_d2_points:i n_concave_up:i n_concave_down:i n_flat:i " + " ".join(f"longest_{n}_run:i longest_{n}_start:s longest_{n}_end:s" for n in ("concave_up", "concave_down", "flat")) + " longest_regime_run:i longest_regime:s current_regime:s current_run_length:i total_runs:i", lambda s, d: o.daily_second_diff_runs(rare(s, d)), _signs("t - 2 * p + pp", 2) + f""",
q AS (SELECT source, {_best(1, 'concave_up', 0)}, {_best(-1, 'concave_down', 0)}, {_best(0, 'flat', 0)}, max(CASE WHEN last THEN s END) AS cs, max(CASE WHEN last THEN steps END) AS current_run_length, count(*) AS total_runs, sum(steps) AS n_d2_points, coalesce(sum(steps) FILTER (s = 1), 0) AS n_concave_up,
  coalesce(sum(steps) FILTER (s = -1), 0) AS n_concave_down, coalesce(sum(steps) FILTER (s = 0), 0) AS n_flat FROM rn2 GROUP BY source),
out AS (SELECT q.*, total_tokens, n_active_days, greatest(longest_concave_up_run, longest_concave_down_run, longest_flat_run) AS longest_regime_run, CASE WHEN longest_concave_up_run >= greatest(longest_concave_down_run, longest_flat_run) THEN 'concaveup' WHEN longest_concave_down_run >= longest_flat_run THEN 'concavedown' ELSE 'flat' END AS longest_regime,
  CASE cs WHEN 1 THEN 'concaveup' WHEN -1 THEN 'concavedown' ELSE 'flat' END AS current_regime FROM q JOIN (SELECT source, sum(t) AS total_tokens, count(*) AS n_active_days FROM dy GROUP BY source HAVING count(*) >= 3) USING (source))"""),
    Query("source_rank_churn", "source:s days_observed:i mean_rank:f stddev_rank:f best_rank:i worst_rank:i distinct_ranks:i total_tokens:i", lambda s, d: o.source_rank_churn(rare(s, d)), _RANK + """,
out AS (SELECT source, count(*) AS days_observed, avg(rank) AS mean_rank, stddev_pop(rank) AS stddev_rank, min(rank) AS best_rank, max(rank) AS worst_rank, count(DISTINCT rank) AS distinct_ranks, sum(t) AS total_tokens FROM rk GROUP BY source)"""),
    Query("source_rank_pairs", "day:s union_size:i footrule:f", lambda s, d: o.source_rank_pairs(rare(s, d)), _RANK + f", out AS (SELECT {DAY.format('d')} AS day, n AS union_size, footrule FROM rp)"),
    Query("source_rank_summary", "day_pairs:i stable_day_pairs:i chaos_day_pairs:i mean_footrule:f median_footrule:f p90_footrule:f max_footrule:f", lambda s, d: o.source_rank_summary(rare(s, d)), _RANK + """,
out AS (SELECT count(*) AS day_pairs, count(*) FILTER (footrule = 0) AS stable_day_pairs, count(*) FILTER (footrule >= 0.5) AS chaos_day_pairs, avg(footrule) AS mean_footrule, quantile_disc(footrule, 0.5) AS median_footrule, quantile_disc(footrule, 0.9) AS p90_footrule, max(footrule) AS max_footrule FROM rp)"""),
]
