"""Queries over cyclic profiles. Rare devices are used where all hours of a source are occupied."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cyclic as c
from ..sources import adapter
from .registry import AS_OF, Query

usage, sessions = adapter.usage, adapter.sessions


def sparse(s, d):
    """Usage of one device, so that hours and days without tokens occur."""
    return usage(s, d).where((F.col("device_id") == "d3") & (F.hour("hour_start") % 5 != 0))


_HEAT = f"""
hm AS (SELECT w AS dow, h AS hour, coalesce(sum(total), 0) AS tokens, count(total) AS events FROM range(1, 8) a(w) CROSS JOIN range(24) b(h)
  LEFT JOIN su ON su.dow + 1 = w AND su.hour = h AND dayno BETWEEN {AS_OF - 29} AND {AS_OF} GROUP BY ALL)"""
_HOW = """
hw0 AS (SELECT w AS weekday, h AS hour, coalesce(sum(total), 0) AS tokens, count(DISTINCT sec) AS buckets FROM range(1, 8) a(w) CROSS JOIN range(24) b(h) LEFT JOIN u ON u.dow + 1 = w AND u.hour = h GROUP BY ALL),
hw AS (SELECT *, tokens / sum(tokens) OVER () AS token_share FROM hw0)"""
_MIX = """
mx0 AS (SELECT hour, source, sum(total) AS tokens, count(*) AS n FROM u GROUP BY ALL),
mx1 AS (SELECT *, tokens / sum(tokens) OVER (PARTITION BY hour) AS p FROM mx0),
mx AS (SELECT hour, sum(tokens) AS total_tokens, sum(n) AS rows, count(*) AS parts, -sum(p * log2(p)) AS entropy_bits, max(p) AS top_share, arg_min(source, (-tokens, source)) AS top_part FROM mx1 GROUP BY hour),
mxe AS (SELECT *, log2(parts) AS max_entropy_bits, CASE WHEN parts > 1 THEN entropy_bits / log2(parts) ELSE 0 END AS normalized_entropy, 2 ** entropy_bits AS effective_parts FROM mx)"""
_SPARSE = """
v AS (SELECT * FROM u WHERE device = 'd3' AND hour % 5 <> 0),
tot AS (SELECT source, sum(total) AS total_tokens, count(DISTINCT sec) AS n_buckets, count(DISTINCT dayno) AS n_days, min(day) AS first_day, max(day) AS last_day, count(DISTINCT hour) AS active_hours FROM v GROUP BY ALL HAVING sum(total) >= 1000),
hh AS (SELECT source, hour, sum(total) AS m FROM v WHERE source IN (SELECT source FROM tot) GROUP BY ALL),
fl AS (SELECT tot.source, CAST(h AS BIGINT) AS h, hh.m IS NOT NULL AS on_ FROM tot CROSS JOIN range(24) r(h) LEFT JOIN hh ON hh.source = tot.source AND hh.hour = h)"""


def _islands(mark: str) -> str:
    other = "NOT on_" if mark == "on_" else "on_"
    return f"""
st AS (SELECT a.source, a.h FROM fl a JOIN fl b ON a.source = b.source AND b.h = (a.h + 23) % 24 WHERE a.{mark.replace('NOT on_', 'on_ = false') if mark != 'on_' else 'on_'} AND {'NOT b.on_' if mark == 'on_' else 'b.on_'}),
rn AS (SELECT st.source, st.h, min((z.h - st.h + 24) % 24) AS n FROM st JOIN fl z ON z.source = st.source AND {'NOT z.on_' if mark == 'on_' else 'z.on_'} GROUP BY ALL),
lg AS (SELECT source, max(n) AS longest, count(*) AS runs, arg_min(h, (-n, h)) AS start FROM rn GROUP BY source)"""


_TOT = "source:s total_tokens:i n_buckets:i first_day:s last_day:s"
QUERIES = [
    Query("heatmap_cells", "dow:i hour:i tokens:i events:i", lambda s, d: c.heatmap_cells(usage(s, d), AS_OF), _HEAT + ", out AS (SELECT * FROM hm)"),
    Query("heatmap_summary", "grand_total:i events:i peak_dow:i peak_hour:i peak_tokens:i peak_cell_dow:i peak_cell_hour:i diurnal_concentration:f weekly_concentration:f", lambda s, d: c.heatmap_summary(usage(s, d), AS_OF), _HEAT + """,
r AS (SELECT dow, sum(tokens) AS t FROM hm GROUP BY dow), k AS (SELECT hour, sum(tokens) AS t FROM hm GROUP BY hour),
f4 AS (SELECT a.hour, sum(b.t) AS t FROM k a JOIN k b ON (b.hour - a.hour + 24) % 24 < 4 GROUP BY a.hour), g AS (SELECT sum(tokens) AS gt, sum(events) AS ev FROM hm),
out AS (SELECT gt AS grand_total, ev AS events, (SELECT arg_min(dow, (-t, dow)) FROM r) AS peak_dow, (SELECT arg_min(hour, (-t, hour)) FROM k) AS peak_hour, (SELECT max(tokens) FROM hm) AS peak_tokens,
  (SELECT arg_min(dow, (-tokens, dow, hour)) FROM hm) AS peak_cell_dow, (SELECT arg_min(hour, (-tokens, dow, hour)) FROM hm) AS peak_cell_hour, (SELECT max(t) FROM f4) / gt AS diurnal_concentration,
  (SELECT sum(t) FROM (SELECT t FROM r ORDER BY t DESC LIMIT 2)) / gt AS weekly_concentration FROM g)"""),
    Query("hour_of_week", "weekday:i hour:i tokens:i buckets:i token_share:f", lambda s, d: c.hour_of_week(usage(s, d)), _HOW + ", out AS (SELECT * FROM hw)"),
    Query("hour_of_week_summary", "total_tokens:i total_buckets:i populated_cells:i dead_cells:i entropy_bits:f normalised_entropy:f gini:f top_k_share:f", lambda s, d: c.hour_of_week_summary(usage(s, d)), _HOW + """,
i AS (SELECT *, row_number() OVER (ORDER BY tokens) AS i FROM hw),
out AS (SELECT sum(tokens) AS total_tokens, sum(buckets) AS total_buckets, count(*) FILTER (tokens > 0) AS populated_cells, count(*) FILTER (tokens = 0) AS dead_cells, -sum(token_share * log2(token_share)) FILTER (tokens > 0) AS entropy_bits,
  -sum(token_share * log2(token_share)) FILTER (tokens > 0) / log2(168) AS normalised_entropy, 2 * sum(i * tokens) / (168 * sum(tokens)) - 169 / 168 AS gini, sum(token_share) FILTER (i > 158) AS top_k_share FROM i)"""),
    Query("hod_source_mix_entropy", "hour:i total_tokens:i rows:i parts:i entropy_bits:f max_entropy_bits:f normalized_entropy:f effective_parts:f top_share:f top_part:s", lambda s, d: c.hod_source_mix_entropy(usage(s, d)), _MIX + ", out AS (SELECT * FROM mxe)"),
    Query("hod_source_mix_summary", "total_tokens:i occupied_hours:i weighted_mean_entropy_bits:f weighted_mean_normalized_entropy:f mono_source_hour_count:i", lambda s, d: c.hod_source_mix_summary(usage(s, d)), _MIX + """,
out AS (SELECT sum(total_tokens) AS total_tokens, count(*) AS occupied_hours, sum(entropy_bits * total_tokens) / sum(total_tokens) AS weighted_mean_entropy_bits,
  sum(normalized_entropy * total_tokens) / sum(total_tokens) AS weighted_mean_normalized_entropy, count(*) FILTER (parts = 1) AS mono_source_hour_count FROM mxe)"""),
    Query("hod_token_skew", "hour:i observed_days:i total_tokens:i mean_daily_tokens:f stddev_daily_tokens:f skewness:f max_daily_tokens:i min_daily_tokens:i", lambda s, d: c.hod_token_skew(usage(s, d)), """
dd AS (SELECT hour, dayno, sum(total) AS t FROM u GROUP BY ALL), mm AS (SELECT *, avg(t) OVER (PARTITION BY hour) AS mu FROM dd),
out AS (SELECT hour, count(*) AS observed_days, sum(t) AS total_tokens, avg(t) AS mean_daily_tokens, stddev_pop(t) AS stddev_daily_tokens, avg((t - mu) ** 3) / avg((t - mu) ** 2) ** 1.5 AS skewness,
  max(t) AS max_daily_tokens, min(t) AS min_daily_tokens FROM mm GROUP BY hour HAVING count(*) >= 2)"""),
    Query("time_of_day", "hour:i sessions:i share:f", lambda s, d: c.time_of_day(sessions(s, d), offset_minutes=330, collapse=2), """
g AS (SELECT ((start_s + 19800) % 86400) // 7200 * 2 AS h, count(*) AS n FROM s GROUP BY ALL),
out AS (SELECT x * 2 AS hour, coalesce(n, 0) AS sessions, coalesce(n, 0) / sum(n) OVER () AS share FROM range(12) r(x) LEFT JOIN g ON h = x * 2)"""),
    Query("time_of_day_by_source", "hour:i source:s sessions:i share:f", lambda s, d: c.time_of_day(sessions(s, d), collapse=6, by_source=True), """
g AS (SELECT (start_s % 86400) // 21600 * 6 AS h, source, count(*) AS n FROM s GROUP BY GROUPING SETS ((h), (h, source))), k AS (SELECT DISTINCT source FROM g),
out AS (SELECT x * 6 AS hour, k.source, coalesce(n, 0) AS sessions, coalesce(n, 0) / sum(n) OVER (PARTITION BY k.source) AS share FROM range(4) r(x) CROSS JOIN k LEFT JOIN g ON h = x * 6 AND g.source IS NOT DISTINCT FROM k.source)"""),
    Query("peak_hour_share", "group:s days:i total_tokens:i mean_peak_share:f p50_peak_share:f p95_peak_share:f max_peak_share:f modal_peak_hour:i modal_peak_hour_count:i", lambda s, d: c.peak_hour_share(usage(s, d)), """
g AS (SELECT model AS "group", dayno, hour, sum(total) AS t FROM u GROUP BY ALL),
dd AS (SELECT "group", dayno, sum(t) AS t, max(t) / sum(t) AS share, arg_min(hour, (-t, hour)) AS h FROM g GROUP BY ALL),
md AS (SELECT "group", h, count(*) AS c FROM dd GROUP BY ALL),
out AS (SELECT "group", count(*) AS days, sum(t) AS total_tokens, avg(share) AS mean_peak_share, quantile_disc(share, 0.5) AS p50_peak_share, quantile_disc(share, 0.95) AS p95_peak_share, max(share) AS max_peak_share,
  (SELECT arg_min(h, (-c, h)) FROM md WHERE md."group" = dd."group") AS modal_peak_hour, (SELECT max(c) FROM md WHERE md."group" = dd."group") AS modal_peak_hour_count FROM dd GROUP BY "group")"""),
    Query("source_dow_mass_share", "source:s total_tokens:i n_days:i first_day:s last_day:s " + " ".join(f"share_{i}:f" for i in range(7)) + " dominant_dow:i dominant_share:f weekend_share:f normalized_entropy:f", lambda s, d: c.source_dow_mass_share(usage(s, d)), """
g AS (SELECT source, sum(total) AS total_tokens, count(DISTINCT dayno) AS n_days, min(day) AS first_day, max(day) AS last_day, list_transform(range(7), lambda i: 0) AS z FROM u GROUP BY ALL HAVING sum(total) >= 1000),
w AS (SELECT source, (dow + 1) % 7 AS d, sum(total) AS m FROM u GROUP BY ALL), p AS (SELECT w.source, d, m / total_tokens AS p FROM w JOIN g USING (source)),
out AS (SELECT g.source, total_tokens, n_days, first_day, last_day, """ + ", ".join(f"coalesce(sum(p) FILTER (d = {i}), 0) AS share_{i}" for i in range(7)) + """,
  arg_min(d, (-p, d)) AS dominant_dow, max(p) AS dominant_share, coalesce(sum(p) FILTER (d IN (0, 6)), 0) AS weekend_share, -sum(p * ln(p)) / ln(7) AS normalized_entropy FROM g JOIN p USING (source) GROUP BY ALL)"""),
    Query("source_hour_centroid", _TOT + " n_days:i centroid_hour:f resultant_length:f spread_hours:f peak_hour:i peak_hour_tokens:i", lambda s, d: c.source_hour_centroid(sparse(s, d)), _SPARSE + """,
xy AS (SELECT source, sum(m * cos(hour * pi() / 12)) / sum(m) AS x, sum(m * sin(hour * pi() / 12)) / sum(m) AS y, arg_min(hour, (-m, hour)) AS peak_hour, max(m) AS peak_hour_tokens FROM hh GROUP BY ALL),
out AS (SELECT tot.*, (atan2(y, x) * 12 / pi() + 24) % 24 AS centroid_hour, sqrt(x * x + y * y) AS resultant_length, sqrt(-2 * ln(sqrt(x * x + y * y))) * 12 / pi() AS spread_hours, peak_hour, peak_hour_tokens FROM tot JOIN xy USING (source))"""),
    Query("source_hod_topk_share", "source:s total_tokens:i n_hours:i first_day:s last_day:s top_k_share:f top_hour_buckets:s uniform_baseline:f", lambda s, d: c.source_hod_topk_share(sparse(s, d)), _SPARSE + """,
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY m DESC, hour) AS i FROM hh),
out AS (SELECT tot.*, active_hours AS n_hours, sum(m) / any_value(total_tokens) AS top_k_share, string_agg(CAST(hour AS VARCHAR), ',' ORDER BY i) AS top_hour_buckets, 0.125 AS uniform_baseline FROM tot JOIN r USING (source) WHERE i <= 3 AND active_hours >= 2 GROUP BY ALL)"""),
    Query("source_dead_hours", _TOT + " dead_hours:i live_hours:i dead_share:f longest_dead_run:i dead_run_count:i", lambda s, d: c.source_dead_hours(sparse(s, d)), _SPARSE + "," + _islands("NOT on_") + """,
out AS (SELECT tot.*, 24 - active_hours AS dead_hours, active_hours AS live_hours, (24 - active_hours) / 24 AS dead_share, longest AS longest_dead_run, runs AS dead_run_count FROM tot JOIN lg USING (source))"""),
    Query("source_active_hour_longest_run", _TOT + " active_hours:i longest_active_run:i active_run_count:i active_run_share:f longest_run_start:i", lambda s, d: c.source_active_hour_longest_run(sparse(s, d)), _SPARSE + "," + _islands("on_") + """,
out AS (SELECT tot.*, longest AS longest_active_run, runs AS active_run_count, longest / active_hours AS active_run_share, start AS longest_run_start FROM tot JOIN lg USING (source))"""),
    Query("source_active_hour_span", _TOT + " active_hours:i circular_span:i span_start_hour:i span_end_hour:i largest_quiet_gap:i span_density:f", lambda s, d: c.source_active_hour_span(sparse(s, d)), _SPARSE + """,
a AS (SELECT source, hour, row_number() OVER (PARTITION BY source ORDER BY hour) AS i, coalesce(lead(hour) OVER (PARTITION BY source ORDER BY hour), min(hour) OVER (PARTITION BY source) + 24) AS nx FROM hh),
b AS (SELECT source, max(nx - hour - 1) AS gap, arg_min(nx % 24, (-(nx - hour - 1), i)) AS st FROM a GROUP BY source),
out AS (SELECT tot.*, 24 - gap AS circular_span, st AS span_start_hour, (st + 23 - gap) % 24 AS span_end_hour, gap AS largest_quiet_gap, active_hours / (24 - gap) AS span_density FROM tot JOIN b USING (source))"""),
    Query("source_hod_entropy", _TOT + " active_hours:i entropy_bits:f entropy_normalized:f effective_hours:f concentration_gap:f top_hour_share:f top_hour:i", lambda s, d: c.source_hod_entropy(sparse(s, d)), _SPARSE + """,
p AS (SELECT source, hour, m, m / sum(m) OVER (PARTITION BY source) AS p FROM hh), x AS (SELECT source, -sum(p * log2(p)) AS e, max(p) AS tp, arg_min(hour, (-m, hour)) AS th FROM p GROUP BY ALL),
out AS (SELECT tot.*, e AS entropy_bits, e / log2(24) AS entropy_normalized, 2 ** e AS effective_hours, active_hours - 2 ** e AS concentration_gap, tp AS top_hour_share, th AS top_hour FROM tot JOIN x USING (source))"""),
]
