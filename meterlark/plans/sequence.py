"""Queries over pairs, hand-offs, switches and sessions."""

from __future__ import annotations

from ..operators import sequence as o
from ..sources import adapter
from .distribution import binned
from .registry import Query
from .tenure import DAY, ISO

usage, sessions, snapshots = adapter.usage, adapter.sessions, adapter.session_snapshots


def _pairs(key: str) -> str:
    return f"""b AS (SELECT {key} AS k, sec, sum(total) AS t FROM u GROUP BY ALL), n AS (SELECT k, count(*) AS n, sum(t) AS t FROM b GROUP BY k),
p AS (SELECT x.k AS a, y.k AS b, count(*) AS c, sum(least(x.t, y.t)) AS w FROM b x JOIN b y ON x.sec = y.sec AND x.k < y.k GROUP BY ALL),
j AS (SELECT p.*, na.n AS na, nb.n AS nb, c / (na.n + nb.n - c) AS jac FROM p JOIN n na ON na.k = a JOIN n nb ON nb.k = b)"""


def _primary(key: str) -> str:
    return f"""b AS (SELECT {key} AS k, sec, sum(total) AS t FROM u GROUP BY ALL), p AS (SELECT sec, sec // 86400 AS dn, arg_min(k, (-t, k)) AS k, max(t) AS t FROM b GROUP BY sec),
h AS (SELECT *, lag(k) OVER (ORDER BY sec) AS pk, (sec - lag(sec) OVER (ORDER BY sec)) / 3600 AS g, lag(dn) OVER (ORDER BY sec) AS pd FROM p), st AS (SELECT k, count(*) AS n FROM p GROUP BY k ORDER BY n DESC, sum(t) DESC, k LIMIT 1)"""


_P = "CASE WHEN {0} LIKE 'claude-%' THEN 'anthropic' WHEN {0} LIKE 'gpt-%' THEN 'openai' WHEN {0} LIKE 'gemini-%' THEN 'google' WHEN {0} IS NOT NULL THEN 'unknown' END"
_PROVIDERS = _primary("model") + f", q AS (SELECT *, {_P.format('k')} AS pr, {_P.format('pk')} AS pp, dn = pd AS same FROM h)"
_ORD = """so AS (SELECT *, (epoch_us(started_at) // 1000) AS sm, greatest((epoch_us(last_message_at) // 1000), (epoch_us(started_at) // 1000) + duration_seconds * 1000) AS em, (epoch_us(last_message_at) // 1000) AS lm FROM s),
sp AS (SELECT *, lag(session_key) OVER w AS pkey, lag(source) OVER w AS psource, lag(sm) OVER w AS psm, lag(em) OVER w AS pem, lag(lm) OVER w AS plm FROM so WINDOW w AS (ORDER BY sm, session_key))"""
_GAP = _ORD + ", gp AS (SELECT *, greatest(0, floor((sm - plm) / 1000)) AS gap FROM sp WHERE pkey IS NOT NULL)"
_TRANS = _ORD + ", tr AS (SELECT psource AS \"from\", source AS \"to\", sm - pem AS raw, greatest(0, sm - pem) AS gap FROM sp WHERE pkey IS NOT NULL AND greatest(0, sm - pem) <= 1800000)"
_LEVEL = _ORD + """, ev AS (SELECT ms, sum(d) AS d FROM (SELECT sm AS ms, 1 AS d FROM so WHERE em > sm UNION ALL SELECT em, -1 FROM so WHERE em > sm) GROUP BY ms),
lv AS (SELECT ms, lead(ms) OVER (ORDER BY ms) AS nx, sum(d) OVER (ORDER BY ms ROWS UNBOUNDED PRECEDING) AS level FROM ev),
hg AS (SELECT level, sum(nx - ms) AS total_ms FROM lv WHERE nx IS NOT NULL GROUP BY level)"""
_RUN = _ORD + """, r0 AS (SELECT *, sum(CASE WHEN source = psource THEN 0 ELSE 1 END) OVER (ORDER BY sm, session_key ROWS UNBOUNDED PRECEDING) AS run FROM sp),
rn AS (SELECT source, run, count(*) AS n, min(sm) AS a FROM r0 GROUP BY ALL)"""
_RUN_STATS = """count(*) AS run_count, sum(n) AS session_count, avg(n) AS mean_run_length, quantile_disc(n, 0.5) AS p50_run_length, quantile_disc(n, 0.9) AS p90_run_length, quantile_disc(n, 0.99) AS p99_run_length, max(n) AS max_run_length,
  count(*) FILTER (n = 1) / sum(n) AS single_session_run_share"""
_RUN_COLUMNS = "run_count:i session_count:i mean_run_length:f p50_run_length:i p90_run_length:i p99_run_length:i max_run_length:i single_session_run_share:f"
_IDLE = "SELECT 'all' AS g, session_key, ((epoch_us(snapshot_at) // 1000) - lag((epoch_us(snapshot_at) // 1000)) OVER (PARTITION BY session_key ORDER BY snapshot_at)) / 1000 AS x FROM ss"
_HOP = """hp AS (SELECT session_key, raw_model AS m, lag(raw_model) OVER (PARTITION BY session_key ORDER BY snapshot_at, started_at, raw_model) AS pm FROM ss),
kd AS (SELECT session_key, count(DISTINCT m) AS d, count(*) FILTER (pm IS NOT NULL AND pm <> m) AS t FROM hp GROUP BY ALL)"""

QUERIES = [
    Query("source_pair_cooccurrence", "a:s b:s count:i jaccard:f share:f", lambda s, d: o.source_pair_cooccurrence(usage(s, d)), _pairs("source") + ", out AS (SELECT a, b, c AS count, jac AS jaccard, c / sum(c) OVER () AS share FROM j ORDER BY c DESC, jac DESC, a, b LIMIT 10)"),
    Query("model_cohabitation", "model_a:s model_b:s co_buckets:i co_tokens:i cohab_index:f co_share_a:f co_share_b:f", lambda s, d: o.model_cohabitation(usage(s, d)), _pairs("model") + ", out AS (SELECT a AS model_a, b AS model_b, c AS co_buckets, w AS co_tokens, jac AS cohab_index, c / na AS co_share_a, c / nb AS co_share_b FROM j)"),
    Query("model_cohabitation_of", "model_a:s model_b:s co_buckets:i co_tokens:i cohab_index:f co_share_a:f co_share_b:f", lambda s, d: o.model_cohabitation(usage(s, d), min_co_buckets=20, by_model="gpt-5.4"), _pairs("model") + """,
out AS (SELECT a AS model_a, b AS model_b, c AS co_buckets, w AS co_tokens, jac AS cohab_index, c / na AS co_share_a, c / nb AS co_share_b FROM j WHERE c >= 20 AND (a = 'gpt-5.4' OR b = 'gpt-5.4'))"""),
    Query("source_pair_floors", "a:s b:s count:i jaccard:f share:f", lambda s, d: o.source_pair_cooccurrence(usage(s, d), min_count=5, min_jaccard=0.2, top=5), _pairs("source") + """,
out AS (SELECT * FROM (SELECT a, b, c AS count, jac AS jaccard, c / sum(c) OVER () AS share FROM j) WHERE count >= 5 AND jaccard >= 0.2 ORDER BY count DESC, jaccard DESC, a, b LIMIT 5)"""),
    Query("model_cohabitation_models", "model:s buckets_active:i tokens:i distinct_cohabitants:i", lambda s, d: o.model_cohabitation_models(usage(s, d)), _pairs("model") + ", out AS (SELECT k AS model, n AS buckets_active, t AS tokens, (SELECT count(*) FROM p WHERE a = k OR b = k) AS distinct_cohabitants FROM n)"),
    Query("bucket_handoff", "from:s to:s count:i", lambda s, d: o.bucket_handoff(usage(s, d)), _primary("model") + ", out AS (SELECT pk AS \"from\", k AS \"to\", count(*) AS count FROM h WHERE pk <> k GROUP BY ALL ORDER BY count DESC, pk, k LIMIT 10)"),
    Query("bucket_handoff_summary", "active_buckets:i considered_pairs:i handoff_pairs:i handoff_share:f contiguous_pairs:i gapped_pairs:i contiguous_handoffs:i gapped_handoffs:i stickiest_model:s stickiest_model_buckets:i", lambda s, d: o.bucket_handoff_summary(usage(s, d)), _primary("model") + """,
out AS (SELECT count(*) AS active_buckets, count(pk) AS considered_pairs, count(*) FILTER (pk <> k) AS handoff_pairs, count(*) FILTER (pk <> k) / count(pk) AS handoff_share, count(*) FILTER (g = 1) AS contiguous_pairs, count(*) FILTER (g <> 1) AS gapped_pairs,
  count(*) FILTER (pk <> k AND g = 1) AS contiguous_handoffs, count(*) FILTER (pk <> k AND g <> 1) AS gapped_handoffs, (SELECT k FROM st) AS stickiest_model, (SELECT n FROM st) AS stickiest_model_buckets FROM h)"""),
    Query("source_handoff_latency", "from:s to:s count:i median_latency_hours:f min_latency_hours:f max_latency_hours:f", lambda s, d: o.source_handoff_latency(usage(s, d)), _primary("source") + """,
out AS (SELECT pk AS "from", k AS "to", count(*) AS count, quantile_cont(g, 0.5) AS median_latency_hours, min(g) AS min_latency_hours, max(g) AS max_latency_hours FROM h WHERE pk <> k GROUP BY ALL ORDER BY count DESC, pk, k LIMIT 10)"""),
    Query("source_handoff_summary", "active_buckets:i considered_pairs:i handoff_pairs:i handoff_share:f median_latency_hours:f mean_latency_hours:f min_latency_hours:f max_latency_hours:f contiguous_handoffs:i gapped_handoffs:i dominant_source:s dominant_source_buckets:i", lambda s, d: o.source_handoff_summary(usage(s, d)), _primary("source") + """,
c AS (SELECT * FROM h WHERE pk <> k),
out AS (SELECT (SELECT count(*) FROM h) AS active_buckets, (SELECT count(pk) FROM h) AS considered_pairs, count(*) AS handoff_pairs, count(*) / (SELECT count(pk) FROM h) AS handoff_share, quantile_cont(g, 0.5) AS median_latency_hours, avg(g) AS mean_latency_hours, min(g) AS min_latency_hours,
  max(g) AS max_latency_hours, count(*) FILTER (g = 1) AS contiguous_handoffs, count(*) FILTER (g <> 1) AS gapped_handoffs, (SELECT k FROM st) AS dominant_source, (SELECT n FROM st) AS dominant_source_buckets FROM c)"""),
    Query("provider_switching_pairs", "from:s to:s count:i", lambda s, d: o.provider_switching_pairs(usage(s, d)), _PROVIDERS + ", out AS (SELECT pp AS \"from\", pr AS \"to\", count(*) AS count FROM q WHERE same AND pp <> pr GROUP BY ALL ORDER BY count DESC, pp, pr LIMIT 10)"),
    Query("provider_switching_days", "day:s active_buckets:i considered_pairs:i switch_pairs:i switch_share:f dominant_provider:s dominant_provider_buckets:i", lambda s, d: o.provider_switching_days(usage(s, d)), _PROVIDERS + f""",
dp AS (SELECT dn, pr, count(*) AS n, sum(t) AS t FROM q GROUP BY ALL), dd AS (SELECT dn, arg_min(pr, (-n, -t, pr)) AS dominant_provider, max(n) AS dominant_provider_buckets FROM dp GROUP BY dn),
dq AS (SELECT dn, count(*) AS active_buckets, count(*) FILTER (same) AS considered_pairs, count(*) FILTER (same AND pp <> pr) AS switch_pairs FROM q GROUP BY dn),
out AS (SELECT {DAY.format('dq.dn')} AS day, active_buckets, considered_pairs, switch_pairs, coalesce(switch_pairs / nullif(considered_pairs, 0), 0) AS switch_share, dominant_provider, dominant_provider_buckets FROM dq JOIN dd USING (dn))"""),
    Query("provider_switching_summary", "active_days:i active_buckets:i considered_pairs:i switch_pairs:i switch_share:f cross_day_pairs:i cross_day_switches:i mean_switches_per_active_day:f days_with_any_switch:i day_coverage:f", lambda s, d: o.provider_switching_summary(usage(s, d)), _PROVIDERS + """,
out AS (SELECT count(DISTINCT dn) AS active_days, count(*) AS active_buckets, count(*) FILTER (same) AS considered_pairs, count(*) FILTER (same AND pp <> pr) AS switch_pairs, count(*) FILTER (same AND pp <> pr) / count(*) FILTER (same) AS switch_share, count(*) FILTER (NOT same) AS cross_day_pairs,
  count(*) FILTER (NOT same AND pp <> pr) AS cross_day_switches, count(*) FILTER (same AND pp <> pr) / count(DISTINCT dn) AS mean_switches_per_active_day, count(DISTINCT dn) FILTER (same AND pp <> pr) AS days_with_any_switch, count(DISTINCT dn) FILTER (same AND pp <> pr) / count(DISTINCT dn) AS day_coverage FROM q)"""),
    Query("session_gaps", "before_key:s after_key:s gap_seconds:i quantile_rank:f", lambda s, d: o.session_gaps(sessions(s, d)), _GAP + """,
th AS (SELECT quantile_disc(gap, 0.9) AS q, count(*) AS n FROM gp),
out AS (SELECT pkey AS before_key, session_key AS after_key, gap AS gap_seconds, ((SELECT count(*) FROM gp g WHERE g.gap < gp.gap) + 0.5 * (SELECT count(*) FROM gp g WHERE g.gap = gp.gap)) / (SELECT n FROM th) AS quantile_rank FROM gp WHERE gap > (SELECT q FROM th) ORDER BY gap DESC, psm, pkey LIMIT 10)"""),
    Query("session_gaps_summary", "total_sessions:i total_gaps:i threshold_seconds:i median_gap_seconds:f max_gap_seconds:i gaps_at_threshold:i", lambda s, d: o.session_gaps_summary(sessions(s, d)), _GAP + """,
out AS (SELECT count(*) + 1 AS total_sessions, count(*) AS total_gaps, quantile_disc(gap, 0.9) AS threshold_seconds, quantile_cont(gap, 0.5) AS median_gap_seconds, max(gap) AS max_gap_seconds, (SELECT count(*) FROM gp WHERE gap = (SELECT quantile_disc(gap, 0.9) FROM gp)) AS gaps_at_threshold FROM gp)"""),
    Query("session_transitions", "from:s to:s count:i median_gap_ms:f p95_gap_ms:i overlap_count:i", lambda s, d: o.session_transitions(sessions(s, d)), _TRANS + ", out AS (SELECT \"from\", \"to\", count(*) AS count, quantile_cont(gap, 0.5) AS median_gap_ms, quantile_disc(gap, 0.95) AS p95_gap_ms, count(*) FILTER (raw < 0) AS overlap_count FROM tr GROUP BY ALL)"),
    Query("session_stickiness", "group:s outgoing:i self_loop:i stickiness:f", lambda s, d: o.session_stickiness(sessions(s, d)), _TRANS + ", out AS (SELECT \"from\" AS \"group\", count(*) AS outgoing, count(*) FILTER (\"from\" = \"to\") AS self_loop, count(*) FILTER (\"from\" = \"to\") / count(*) AS stickiness FROM tr GROUP BY ALL)"),
    Query("concurrency_histogram", "level:i total_ms:i fraction:f", lambda s, d: o.concurrency_histogram(sessions(s, d)), _LEVEL + ", out AS (SELECT *, total_ms / sum(total_ms) OVER () AS fraction FROM hg)"),
    Query("session_concurrency", "window_ms:i peak_concurrency:i peak_at:s peak_duration_ms:i average_concurrency:f coverage:f p95_concurrency:i", lambda s, d: o.session_concurrency(sessions(s, d)), _LEVEL + f""",
hc AS (SELECT *, sum(total_ms) OVER (ORDER BY level) AS cum, sum(total_ms) OVER () AS w FROM hg),
out AS (SELECT max(w) AS window_ms, (SELECT max(level) FROM lv) AS peak_concurrency, (SELECT {ISO.format('CAST((min(ms) // 1000) AS BIGINT)')} FROM lv WHERE level = (SELECT max(level) FROM lv)) AS peak_at, max(total_ms) FILTER (level = (SELECT max(level) FROM lv)) AS peak_duration_ms, sum(level * total_ms) / max(w) AS average_concurrency,
  sum(total_ms) FILTER (level >= 1) / max(w) AS coverage, min(level) FILTER (cum / w >= 0.95) AS p95_concurrency FROM hc)"""),
    Query("concurrency_peak_sessions", "session_key:s source:s kind:s start_ms:i end_ms:i", lambda s, d: o.concurrency_peak_sessions(sessions(s, d)), _LEVEL + """,
pk AS (SELECT min(ms) AS t FROM lv WHERE level = (SELECT max(level) FROM lv)), out AS (SELECT session_key, source, kind, sm AS start_ms, em AS end_ms FROM so JOIN pk ON sm <= t AND em > t ORDER BY session_key LIMIT 10)"""),
    Query("source_run_lengths", "source:s " + _RUN_COLUMNS + " longest_run_started_at:s", lambda s, d: o.source_run_lengths(sessions(s, d)), _RUN + f", out AS (SELECT source, {_RUN_STATS}, {ISO.format('(arg_min(a, (-n, a)) // 1000)')} AS longest_run_started_at FROM rn GROUP BY source)"),
    Query("source_run_lengths_global", _RUN_COLUMNS, lambda s, d: o.source_run_lengths_global(sessions(s, d)), _RUN + f", out AS (SELECT {_RUN_STATS} FROM rn)"),
    *binned("idle_gaps", o.IDLE_EDGES, lambda s, d: o.idle_gaps(snapshots(s, d)), f"SELECT g, x FROM ({_IDLE}) WHERE x IS NOT NULL"),
    Query("idle_gap_top_sessions", "session_key:s gap_count:i max_gap_seconds:f total_gap_seconds:f", lambda s, d: o.idle_gap_top_sessions(snapshots(s, d)), f"""i AS ({_IDLE}),
out AS (SELECT session_key, count(x) AS gap_count, max(x) AS max_gap_seconds, sum(x) AS total_gap_seconds FROM i WHERE x IS NOT NULL GROUP BY ALL ORDER BY max_gap_seconds DESC, total_gap_seconds DESC, session_key LIMIT 10)"""),
    Query("model_switching", "group:s considered_sessions:i switched_sessions:i switched_share:f total_transitions:i mean_models_per_switched_session:f p50_distinct_models:i p90_distinct_models:i p99_distinct_models:i max_distinct_models:i with_1:i with_2:i with_3:i with_4:i", lambda s, d: o.model_switching(snapshots(s, d)), _HOP + """,
out AS (SELECT 'all' AS "group", count(*) AS considered_sessions, count(*) FILTER (d >= 2) AS switched_sessions, count(*) FILTER (d >= 2) / count(*) AS switched_share, sum(t) FILTER (d >= 2) AS total_transitions, avg(d) FILTER (d >= 2) AS mean_models_per_switched_session,
  quantile_disc(d, 0.5) AS p50_distinct_models, quantile_disc(d, 0.9) AS p90_distinct_models, quantile_disc(d, 0.99) AS p99_distinct_models, max(d) AS max_distinct_models, count(*) FILTER (d = 1) AS with_1, count(*) FILTER (d = 2) AS with_2, count(*) FILTER (d = 3) AS with_3, count(*) FILTER (d >= 4) AS with_4 FROM kd)"""),
    Query("model_switch_pairs", "from:s to:s count:i share:f", lambda s, d: o.model_switch_pairs(snapshots(s, d)), _HOP + """,
g AS (SELECT pm AS "from", m AS "to", count(*) AS count FROM hp JOIN kd USING (session_key) WHERE pm <> m AND d >= 2 GROUP BY ALL), out AS (SELECT *, count / sum(count) OVER () AS share FROM g ORDER BY count DESC, "from", "to" LIMIT 10)"""),
    Query("runs_retention", "name:s day:s status:s", lambda s, d: o.runs_retention(adapter.runs(s, d)), """
r AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS name, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS status FROM orders),
out AS (SELECT * FROM r WHERE name NOT IN (SELECT name FROM r ORDER BY name DESC LIMIT 100) AND name NOT IN (SELECT max(name) FROM r WHERE status = 'succeeded' GROUP BY day))"""),
]
