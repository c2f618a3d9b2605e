"""Queries over distributions."""

from __future__ import annotations

from ..functions import cells, dims, stats
from ..operators import distribution as o
from ..sources import adapter
from .registry import COUNTED, COUNTED_COLUMNS, COUNTED_SQL, Query

usage, sessions = adapter.usage, adapter.sessions


def _case(value: str, edges, strict: bool = True) -> str:
    return " + ".join(f"CASE WHEN {value} {'>' if strict else '>='} {e} THEN 1 ELSE 0 END" for e in edges)


def _deciles(metric: str) -> list[Query]:
    base = f"r0 AS (SELECT {metric} AS x FROM su WHERE {metric} > 0), r AS (SELECT x, ntile(10) OVER (ORDER BY x) AS d, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM r0)"
    return [
        Query(f"{metric}_token_deciles", "decile:i bucket_count:i tokens_in_decile:i share_of_tokens:f mean_tokens:f min_tokens:i max_tokens:i", lambda s, d: o.token_deciles(usage(s, d), metric), base + """,
out AS (SELECT d AS decile, count(*) AS bucket_count, sum(x) AS tokens_in_decile, sum(x) / sum(sum(x)) OVER () AS share_of_tokens, avg(x) AS mean_tokens, min(x) AS min_tokens, max(x) AS max_tokens FROM r GROUP BY d)"""),
        Query(f"{metric}_token_decile_summary", "bucket_count:i total_tokens:i gini:f p90_share:f p99_share:f", lambda s, d: o.token_decile_summary(usage(s, d), metric), base + """,
out AS (SELECT max(n) AS bucket_count, sum(x) AS total_tokens, 2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n) AS gini, sum(x) FILTER (i > n - ceil(n * 0.1)) / sum(x) AS p90_share, sum(x) FILTER (i > n - ceil(n * 0.01)) / sum(x) AS p99_share FROM r)"""),
    ]


def _percentiles(key: str, value: str, rows: str) -> str:
    return f"""g AS ({rows}),
out AS (SELECT {key}, count(*) AS buckets, sum({value}) AS sum, min({value}) AS min, quantile_disc({value}, 0.5) AS p50, quantile_disc({value}, 0.9) AS p90, quantile_disc({value}, 0.99) AS p99, max({value}) AS max, avg({value}) AS mean"""


def _size(name: str, metric: str, edges) -> list[Query]:
    bins = ", ".join(f"({i}, {e})" for i, e in enumerate(edges))
    base = f"x AS (SELECT model AS g, {metric} AS v, {_case(metric, edges, False)} - 1 AS i FROM su WHERE {metric} > 0)"
    return [
        Query(name, "group:s rows:i total_tokens:i mean_tokens:f p95_tokens:i max_tokens:i", lambda s, d: o.size_summary(usage(s, d), metric, "model"), base + """,
out AS (SELECT g AS "group", count(*) AS rows, sum(v) AS total_tokens, avg(v) AS mean_tokens, quantile_disc(v, 0.95) AS p95_tokens, max(v) AS max_tokens FROM x GROUP BY g)"""),
        Query(f"{name}_bins", "group:s lower:i rows:i share:f", lambda s, d: o.size_bins(usage(s, d), metric, "model", edges), base + f""",
b(i, lower) AS (VALUES {bins}), n AS (SELECT DISTINCT g FROM x UNION ALL SELECT NULL),
c AS (SELECT n.g AS "group", lower, count(x.v) AS rows FROM n CROSS JOIN b LEFT JOIN x ON x.i = b.i AND (n.g IS NULL OR x.g = n.g) GROUP BY ALL),
out AS (SELECT *, rows / sum(rows) OVER (PARTITION BY "group") AS share FROM c)"""),
    ]


def binned(name: str, edges, job, rows: str, extra: str = "") -> list[Query]:
    """Two queries over measured rows. ``rows``: SQL of (g, x)."""
    uppers = [*map(str, edges), "NULL"]
    bins = ", ".join(f"({i}, {edges[i - 1] if i else 0}, {u})" for i, u in enumerate(uppers))
    base = f"m AS ({rows}), mi AS (SELECT *, {_case('x', edges)} AS i FROM m)"
    return [
        Query(name, "group:s n:i mean:f p50:f p90:f p95:f p99:f max:f modal_bin_index:i" + (" stdev:f" if extra else ""), lambda s, d: stats.distribution(job(s, d), "group", "x", edges), base + """,
k AS (SELECT g, i, count(*) AS c FROM mi GROUP BY ALL),
out AS (SELECT g AS "group", count(*) AS n, avg(x) AS mean, quantile_disc(x, 0.5) AS p50, quantile_disc(x, 0.9) AS p90, quantile_disc(x, 0.95) AS p95, quantile_disc(x, 0.99) AS p99, max(x) AS max, stddev_samp(x) AS stdev,
  (SELECT arg_min(i, (-c, i)) FROM k WHERE k.g = mi.g) AS modal_bin_index FROM mi GROUP BY g)"""),
        Query(f"{name}_bins", "group:s bin_index:i lower:f upper:f count:i share:f cumulative_share:f median:f mean:f", lambda s, d: stats.binned(job(s, d), "group", "x", edges), base + f""",
b(bin_index, lower, upper) AS (VALUES {bins}), n AS (SELECT DISTINCT g FROM m),
c AS (SELECT n.g AS "group", bin_index, lower, upper, count(x) AS count, coalesce(quantile_disc(x, 0.5), 0) AS median, coalesce(avg(x), 0) AS mean FROM n CROSS JOIN b LEFT JOIN mi ON mi.i = b.bin_index AND mi.g = n.g GROUP BY ALL),
out AS (SELECT *, count / sum(count) OVER (PARTITION BY "group") AS share, sum(count) OVER (PARTITION BY "group" ORDER BY bin_index) / sum(count) OVER (PARTITION BY "group") AS cumulative_share FROM c)"""),
    ]


_B = "SELECT {k}, sec, sum(total) AS t FROM u GROUP BY ALL"
_FIT = """count(*) AS active_buckets, sum(t) AS total_tokens, sum(x) AS total_input_tokens, sum(y) AS total_output_tokens, avg(x) AS mean_input, avg(y) AS mean_output, stddev_pop(x) AS std_input, stddev_pop(y) AS std_output,
  corr(y, x) AS pearson_r, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, false AS degenerate FROM pt"""
_FIT_COLUMNS = "active_buckets:i total_tokens:i total_input_tokens:i total_output_tokens:i mean_input:f mean_output:f std_input:f std_output:f pearson_r:f slope:f intercept:f degenerate:b"
_PT = "pt AS (SELECT model AS g, sec, sum(input) AS x, sum(output) AS y, sum(total) AS t FROM u GROUP BY ALL)"
_GINI = "sum((2 * i - n - 1) * t) / (max(n) * sum(t))"
_BG = """bg0 AS (SELECT source, sec, sum(total) AS t FROM u GROUP BY ALL),
bg1 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t) AS i, count(*) OVER (PARTITION BY source) AS n FROM bg0),
bg AS (SELECT source, count(*) AS bucket_count, sum(t) AS total_tokens, """ + _GINI + """ AS gini, avg(t) AS mean_tokens, max(t) AS max_bucket_tokens, max(t) / sum(t) AS top_bucket_share, min(sec) AS a, max(sec) AS b FROM bg1 GROUP BY source)"""
_BF = """bf0 AS (SELECT source, CAST(substr(CAST(output AS VARCHAR), 1, 1) AS BIGINT) AS dg, count(*) AS c, sum(output) AS t FROM su WHERE output > 0 GROUP BY ALL),
bt AS (SELECT source, sum(c) AS n_rows, sum(t) AS total_tokens FROM bf0 GROUP BY source HAVING sum(c) >= 30),
bf AS (SELECT bt.source, n_rows, total_tokens, x AS digit, coalesce(c, 0) AS observed, log10(1 + 1 / x) AS expected_freq, log10(1 + 1 / x) * n_rows AS expected, coalesce(c, 0) / n_rows AS observed_freq
  FROM bt CROSS JOIN range(1, 10) r(x) LEFT JOIN bf0 ON bf0.source = bt.source AND dg = x)"""
_P10 = {"p1": 0.01, "p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
_INT = [f"count(*) FILTER (t >= {lo}{f' AND t < {hi}' if hi else ''}) AS from_{lo}" for lo, hi in zip(o.INTENSITY_EDGES, [*o.INTENSITY_EDGES[1:], None], strict=True)]
_ISO = "strftime(make_timestamp({0} * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"

QUERIES = [
    Query("bucket_density_percentile", "total_buckets:i total_tokens:i min:i " + " ".join(f"{p}:i" for p in _P10) + " max:i mean:f", lambda s, d: o.bucket_density_percentile(usage(s, d)),
          "out AS (SELECT count(*) AS total_buckets, sum(total) AS total_tokens, min(total) AS min, " + ", ".join(f"quantile_disc(total, {q}) AS {p}" for p, q in _P10.items()) + ", max(total) AS max, avg(total) AS mean FROM u)"),
    Query("bucket_density_deciles", "decile:i count:i tokens:i token_share:f lower_edge:i upper_edge:i", lambda s, d: o.bucket_density_deciles(usage(s, d), trim_top_pct=1.0), """
r AS (SELECT total AS x, row_number() OVER (ORDER BY total) - 1 AS i, count(*) OVER () - floor(count(*) OVER () * 0.01) AS n FROM u),
dc AS (SELECT r.x, dd AS d FROM r JOIN range(1, 11) q(dd) ON i >= floor(n * (dd - 1) / 10) AND i < floor(n * dd / 10)),
out AS (SELECT d AS decile, count(*) AS count, sum(x) AS tokens, sum(x) / sum(sum(x)) OVER () AS token_share, min(x) AS lower_edge, max(x) AS upper_edge FROM dc GROUP BY d)"""),
    *_deciles("input"), *_deciles("output"),
    Query("input_token_top_buckets", "hour_start:s source:s model:s tokens:i share_of_total:f", lambda s, d: o.input_token_buckets(usage(s, d)), """
out AS (SELECT iso AS hour_start, source, model, input AS tokens, input / (SELECT sum(input) FROM su) AS share_of_total FROM su WHERE input > 0 ORDER BY input DESC, sec, source, model LIMIT 10)"""),
    Query("bucket_intensity", "model:s buckets:i sum:i min:i p50:i p90:i p99:i max:i mean:f spread:f " + " ".join(f"from_{e}:i" for e in o.INTENSITY_EDGES), lambda s, d: o.bucket_intensity(usage(s, d)),
          _percentiles("model", "t", _B.format(k="model")) + ", p99 / p50 AS spread, " + ", ".join(_INT) + " FROM g GROUP BY model)"),
    Query("token_velocity_percentiles", "source:s buckets:i tokens:i min:f p50:f p90:f p99:f max:f mean:f", lambda s, d: o.token_velocity_percentiles(usage(s, d)),
          _percentiles("source", "v", "SELECT source, sec, sum(total) AS t, sum(total) / 60 AS v FROM u GROUP BY ALL") + ", sum(t) AS tokens FROM g GROUP BY source)"),
    Query("cost_per_bucket_percentiles", "source:s buckets:i sum:e min:f p50:f p90:f p99:f max:f mean:f", lambda s, d: o.cost_per_bucket_percentiles(usage(s, d), dims.rates(s)),
          _percentiles("source", "v", "SELECT source, sec, sum(coalesce(input * ri + cached * rc + output * ro + reasoning * rr, 0)) / 1e6 AS v FROM su LEFT JOIN rates r ON r.model = su.model GROUP BY source, sec HAVING v > 0") + " FROM g GROUP BY source)"),
    Query("bucket_token_gini", "source:s bucket_count:i total_tokens:i gini:f mean_tokens:f max_bucket_tokens:i top_bucket_share:f active_window_start:s active_window_end:s", lambda s, d: o.bucket_token_gini(usage(s, d)),
          _BG + f", out AS (SELECT *, {_ISO.format('a')} AS active_window_start, {_ISO.format('b')} AS active_window_end FROM bg)"),
    Query("bucket_token_gini_summary", "total_tokens:i observed_sources:i weighted_mean_gini:f unweighted_mean_gini:f single_bucket_source_count:i", lambda s, d: o.bucket_token_gini_summary(usage(s, d)),
          _BG + ", out AS (SELECT sum(total_tokens) AS total_tokens, count(*) AS observed_sources, sum(gini * total_tokens) / sum(total_tokens) AS weighted_mean_gini, avg(gini) AS unweighted_mean_gini, count(*) FILTER (bucket_count = 1) AS single_bucket_source_count FROM bg)"),
    Query("daily_token_gini", "source:s total_tokens:i n_days:i first_day:s last_day:s gini:f mean_daily_tokens:f max_daily_tokens:i max_day:s max_day_share:f", lambda s, d: o.daily_token_gini(usage(s, d)), """
g0 AS (SELECT source, day, sum(total) AS t FROM u GROUP BY ALL), g1 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t) AS i, count(*) OVER (PARTITION BY source) AS n FROM g0),
out AS (SELECT source, sum(t) AS total_tokens, count(*) AS n_days, min(day) AS first_day, max(day) AS last_day, """ + _GINI + """ AS gini, avg(t) AS mean_daily_tokens, max(t) AS max_daily_tokens, arg_min(day, (-t, day)) AS max_day, max(t) / sum(t) AS max_day_share
  FROM g1 GROUP BY source HAVING sum(t) >= 1000 AND count(*) >= 2)"""),
    Query("tail_share", "source:s bucket_count:i tokens:i top1_share:f top5_share:f top10_share:f top20_share:f gini_like:f", lambda s, d: o.tail_share(usage(s, d)), """
g0 AS (SELECT source, sec, sum(total) AS t FROM u GROUP BY ALL), g1 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t DESC) AS i, count(*) OVER (PARTITION BY source) AS n FROM g0),
g2 AS (SELECT source, max(n) AS bucket_count, sum(t) AS tokens, """ + ", ".join(f"sum(t) FILTER (i <= ceil(n * {p / 100})) / sum(t) AS top{p}_share" for p in (1, 5, 10, 20)) + """,
  (ceil(max(n) * 0.01) + ceil(max(n) * 0.05) + ceil(max(n) * 0.1) + ceil(max(n) * 0.2)) / (4 * max(n)) AS base FROM g1 GROUP BY source),
out AS (SELECT *, greatest(0, ((top1_share + top5_share + top10_share + top20_share) / 4 - base) / (1 - base)) AS gini_like FROM g2)"""),
    *_size("prompt_size", "input", o.PROMPT_EDGES), *_size("output_size", "output", o.OUTPUT_EDGES),
    Query("burstiness", "group:s total_tokens:i active_hours:i mean_tokens_per_hour:f stddev_tokens_per_hour:f cv:f p50_tokens_per_hour:f p95_tokens_per_hour:f max_tokens_per_hour:i burst_ratio:f", lambda s, d: o.burstiness(usage(s, d)), """
g AS (SELECT model AS "group", sec, sum(total) AS t FROM u GROUP BY ALL),
out AS (SELECT "group", sum(t) AS total_tokens, count(*) AS active_hours, avg(t) AS mean_tokens_per_hour, stddev_pop(t) AS stddev_tokens_per_hour, stddev_pop(t) / avg(t) AS cv, quantile_cont(t, 0.5) AS p50_tokens_per_hour,
  quantile_cont(t, 0.95) AS p95_tokens_per_hour, max(t) AS max_tokens_per_hour, max(t) / quantile_cont(t, 0.5) AS burst_ratio FROM g GROUP BY "group")"""),
    Query("rolling_bucket_cv", "source:s total_tokens:i active_buckets:i window_count:i global_cv:f min_cv:f p50_cv:f p90_cv:f max_cv:f mean_cv:f peak_window_start:s", lambda s, d: o.rolling_bucket_cv(usage(s, d)), """
g AS (SELECT source, sec, sum(total) AS t FROM u GROUP BY ALL),
w AS (SELECT *, count(*) OVER k AS n, stddev_pop(t) OVER k / avg(t) OVER k AS cv FROM g WINDOW k AS (PARTITION BY source ORDER BY sec ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
p AS (SELECT source, count(*) AS window_count, min(cv) AS min_cv, quantile_disc(cv, 0.5) AS p50_cv, quantile_disc(cv, 0.9) AS p90_cv, max(cv) AS max_cv, avg(cv) AS mean_cv, arg_min(sec, (-round(cv, 12), sec)) AS ps FROM w WHERE n = 12 GROUP BY source),
q AS (SELECT source, sum(t) AS total_tokens, count(*) AS active_buckets, stddev_pop(t) / avg(t) AS global_cv FROM g GROUP BY source),
out AS (SELECT *, """ + _ISO.format("ps") + " AS peak_window_start FROM q JOIN p USING (source))"),
    Query("rolling_bucket_cv_counted", "source:s total_tokens:i active_buckets:i window_count:i global_cv:f min_cv:f max_cv:f mean_cv:f" + COUNTED_COLUMNS + "dropped_low_cv_windows:i dropped_min_buckets:i dropped_sparse_sources:i dropped_all_windows_floored:i",
          lambda s, d: o.rolling_bucket_cv_counted(usage(s, d), window_size=6, min_buckets=10, min_window_cv=0.6, **COUNTED), COUNTED_SQL + """,
g AS (SELECT source, sec, sum(total) AS t FROM v GROUP BY ALL),
w AS (SELECT *, count(*) OVER k AS n, stddev_pop(t) OVER k / avg(t) OVER k AS cv FROM g WINDOW k AS (PARTITION BY source ORDER BY sec ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
p AS (SELECT source, count(*) FILTER (cv >= 0.6) AS window_count, min(cv) FILTER (cv >= 0.6) AS min_cv, max(cv) FILTER (cv >= 0.6) AS max_cv, avg(cv) FILTER (cv >= 0.6) AS mean_cv, count(*) FILTER (cv < 0.6) AS low FROM w WHERE n = 6 GROUP BY source),
q AS (SELECT source, sum(t) AS total_tokens, count(*) AS active_buckets, stddev_pop(t) / avg(t) AS global_cv FROM g GROUP BY source),
f AS (SELECT *, CASE WHEN active_buckets < 10 THEN 1 WHEN active_buckets < 6 THEN 2 WHEN coalesce(window_count, 0) = 0 THEN 3 ELSE 0 END AS why FROM q LEFT JOIN p USING (source)),
out AS (SELECT * FROM c0 CROSS JOIN (SELECT coalesce(sum(low) FILTER (why IN (0, 3)), 0) AS dropped_low_cv_windows, count(*) FILTER (why = 1) AS dropped_min_buckets, count(*) FILTER (why = 2) AS dropped_sparse_sources, count(*) FILTER (why = 3) AS dropped_all_windows_floored FROM f)
  LEFT JOIN (SELECT * FROM f WHERE why = 0) ON true)"""),
    Query("model_mix_entropy", "source:s total_tokens:i rows:i parts:i entropy_bits:f max_entropy_bits:f normalized_entropy:f effective_parts:f top_share:f top_part:s", lambda s, d: o.model_mix_entropy(usage(s, d)), """
x0 AS (SELECT source, model, sum(total) AS tokens, count(*) AS n FROM u GROUP BY ALL), x1 AS (SELECT *, tokens / sum(tokens) OVER (PARTITION BY source) AS p FROM x0),
out AS (SELECT source, sum(tokens) AS total_tokens, sum(n) AS rows, count(*) AS parts, -sum(p * log2(p)) AS entropy_bits, log2(count(*)) AS max_entropy_bits, CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END AS normalized_entropy,
  2 ** (-sum(p * log2(p))) AS effective_parts, max(p) AS top_share, arg_min(model, (-tokens, model)) AS top_part FROM x1 GROUP BY source)"""),
    Query("prompt_output_correlation", "group:s " + _FIT_COLUMNS, lambda s, d: o.prompt_output_correlation(usage(s, d)), _PT + f", out AS (SELECT g AS \"group\", {_FIT} GROUP BY g HAVING count(*) >= 2)"),
    Query("prompt_output_correlation_global", _FIT_COLUMNS, lambda s, d: o.prompt_output_correlation_global(usage(s, d)), _PT + f", out AS (SELECT {_FIT})"),
    Query("source_io_ratio_stability", "source:s tokens:i input_tokens:i output_tokens:i active_days:i days_with_ratio:i days_with_zero_input:i mean_ratio:f std_ratio:f ratio_cv:f flat_line:b single_sample:b", lambda s, d: o.source_io_ratio_stability(usage(s, d)), """
g AS (SELECT source, dayno, sum(input) AS i, sum(output) AS q, sum(total) AS t, sum(output) / nullif(sum(input), 0) AS r FROM su GROUP BY ALL),
out AS (SELECT source, sum(t) AS tokens, sum(i) AS input_tokens, sum(q) AS output_tokens, count(*) AS active_days, count(r) AS days_with_ratio, count(*) FILTER (i <= 0) AS days_with_zero_input, avg(r) AS mean_ratio, stddev_pop(r) AS std_ratio,
  stddev_pop(r) / avg(r) AS ratio_cv, avg(r) = 0 AS flat_line, count(r) = 1 AS single_sample FROM g GROUP BY source HAVING count(r) >= 3)"""),
    Query("source_benford_digits", "source:s digit:i observed:i expected:f observed_freq:f expected_freq:f", lambda s, d: o.source_benford_digits(usage(s, d)), _BF + ", out AS (SELECT * FROM bf)"),
    Query("source_benford", "source:s n_rows:i total_tokens:i chi2:f mad_percent:f mode_digit:i mode_freq:f", lambda s, d: o.source_benford(usage(s, d)), _BF + """,
out AS (SELECT source, n_rows, total_tokens, sum((observed - expected) ** 2 / expected) AS chi2, avg(abs(observed_freq - expected_freq)) * 100 AS mad_percent, arg_min(digit, (-observed, digit)) AS mode_digit, max(observed) / any_value(n_rows) AS mode_freq FROM bf GROUP BY source, n_rows, total_tokens)"""),
    Query("session_summary", "key:s sessions:i total_duration_seconds:i total_messages:i median_duration_seconds:f", lambda s, d: o.session_summary(sessions(s, d)), """
out AS (SELECT source AS key, count(*) AS sessions, sum(duration_seconds) AS total_duration_seconds, sum(total_messages) AS total_messages, quantile_cont(duration_seconds, 0.5) AS median_duration_seconds FROM s GROUP BY source)"""),
    Query("session_summary_totals", "total_sessions:i " + " ".join(f"total_{n}:i median_{n}:f mean_{n}:f p95_{n}:i min_{n}:i max_{n}:i most_{n}:s" for n in ("duration", "messages")), lambda s, d: o.session_summary_totals(sessions(s, d)),
          "out AS (SELECT count(*) AS total_sessions, " + ", ".join(f"sum({c}) AS total_{n}, quantile_cont({c}, 0.5) AS median_{n}, avg({c}) AS mean_{n}, quantile_disc({c}, 0.95) AS p95_{n}, min({c}) AS min_{n}, max({c}) AS max_{n}, arg_min(session_key, (-{c}, session_key)) AS most_{n}" for c, n in (("duration_seconds", "duration"), ("total_messages", "messages"))) + " FROM s)"),
    *binned("session_lengths", o.LENGTH_EDGES, lambda s, d: o.session_lengths(sessions(s, d)), "SELECT 'all' AS g, CAST(duration_seconds AS DOUBLE) AS x FROM s WHERE duration_seconds >= 0"),
    *binned("reply_ratio", o.REPLY_EDGES, lambda s, d: o.reply_ratio(sessions(s, d), by="source"), "SELECT source AS g, assistant_messages / user_messages AS x FROM s WHERE total_messages >= 2 AND user_messages > 0"),
    *binned("turn_cadence", o.CADENCE_EDGES, lambda s, d: o.turn_cadence(sessions(s, d), by="source"), "SELECT source AS g, duration_seconds / user_messages AS x FROM s WHERE duration_seconds >= 1 AND user_messages >= 1", "stdev"),
    *binned("message_volume", o.VOLUME_EDGES, lambda s, d: o.message_volume(sessions(s, d), by="kind"), "SELECT kind AS g, CAST(total_messages AS DOUBLE) AS x FROM s WHERE total_messages >= 1"),
    Query("message_volume_above", "group:s above_threshold_share:f", lambda s, d: o.above_share(o.message_volume(sessions(s, d)), 2), "out AS (SELECT 'all' AS \"group\", avg(CAST(total_messages > 2 AS DOUBLE)) AS above_threshold_share FROM s WHERE total_messages >= 1)"),
    Query("usage_drop_counters", "kept_rows:i dropped_invalid_hour_start:i dropped_zero_tokens:i dropped_source_filter:i dropped_model_filter:i", lambda s, d: cells.drops(usage(s, d), since="2024-01-05T00:00:00Z", source="click", model="gpt-5.4"), """
r AS (SELECT * FROM su WHERE t >= TIMESTAMP '2024-01-05'),
out AS (SELECT count(*) FILTER (total > 0 AND source = 'click' AND model = 'gpt-5.4') AS kept_rows, 0 AS dropped_invalid_hour_start, count(*) FILTER (total <= 0) AS dropped_zero_tokens, count(*) FILTER (total > 0 AND source <> 'click') AS dropped_source_filter,
  count(*) FILTER (total > 0 AND source = 'click' AND model <> 'gpt-5.4') AS dropped_model_filter FROM r)"""),
    Query("session_drop_counters", " ".join(f"{c}:i" for c in ("dropped_invalid_started_at", "reply_dropped_min_messages", "reply_dropped_zero_user", "reply_kept", "cadence_dropped_min_duration", "cadence_dropped_zero_user", "cadence_dropped_min_user", "cadence_kept")), lambda s, d: o.session_drops(sessions(s, d), min_user=2), """
out AS (SELECT 0 AS dropped_invalid_started_at, count(*) FILTER (total_messages < 2) AS reply_dropped_min_messages, count(*) FILTER (total_messages >= 2 AND user_messages = 0) AS reply_dropped_zero_user, count(*) FILTER (total_messages >= 2 AND user_messages > 0) AS reply_kept,
  count(*) FILTER (duration_seconds < 1) AS cadence_dropped_min_duration, count(*) FILTER (duration_seconds >= 1 AND user_messages = 0) AS cadence_dropped_zero_user, count(*) FILTER (duration_seconds >= 1 AND user_messages = 1) AS cadence_dropped_min_user,
  count(*) FILTER (duration_seconds >= 1 AND user_messages >= 2) AS cadence_kept FROM s)"""),
    Query("output_token_bottom_buckets", "hour_start:s source:s model:s tokens:i share_of_total:f", lambda s, d: o.input_token_buckets(usage(s, d), largest=False, metric="output"), """
out AS (SELECT iso AS hour_start, source, model, output AS tokens, output / (SELECT sum(output) FROM su) AS share_of_total FROM su WHERE output > 0 ORDER BY output, sec, source, model LIMIT 10)"""),
]
