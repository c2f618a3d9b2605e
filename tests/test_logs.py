"""Hand-computed cases for the scans, the dimensions and the reports."""

from __future__ import annotations

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from meterlark.functions import cells, dims, stats
from meterlark.operators import cyclic, distribution, sequence, series, tenure, totals
from meterlark.sources import logs

USAGE = "source string, model string, hour_start timestamp, device_id string, input_tokens long, cached_input_tokens long, output_tokens long, reasoning_output_tokens long, total_tokens long"
SESSION = "session_key string, source string, kind string, started_at timestamp, last_message_at timestamp, duration_seconds long, user_messages long, assistant_messages long, total_messages long, project_ref string, model string, snapshot_at timestamp"


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


def usage(spark, *rows):
    """Rows of (time, total, source, model[, input, cached, output, reasoning, device])."""
    full = []
    for r in rows:
        t, total, source, model, *rest = r
        i, c, o, g, d = [*rest, *[total, 0, 0, 0, "d1"][len(rest):]]
        full.append((source, model, at(t) if t else None, d, i, c, o, g, total))
    return spark.createDataFrame(full, USAGE)


def sessions(spark, *rows):
    """Rows of (key, source, start, end, user, assistant[, model, snapshot])."""
    full = []
    for key, source, a, b, u, m, *rest in rows:
        model, snap = [*rest, *["gpt-5.4", b][len(rest):]]
        full.append((key, source, "human", at(a), at(b), int((at(b) - at(a)).total_seconds()), u, m, u + m, "p1", model, at(snap)))
    return spark.createDataFrame(full, SESSION)


def one(df):
    return df.first().asDict()


def test_normalise_model(spark):
    names = {
        None: "unknown", "": "unknown", "opus": "unknown", "<synthetic>": "unknown", "github_copilot/Claude Opus 4.7": "claude-opus-4.7", "OpenRouter/gpt-5": "gpt-5",
        "claude-haiku-4-5-20251001": "claude-haiku-4.5", "copilot/synthetic": "unknown", "a-1-2-3": "a-1.2.3", "copilot/openrouter/x": "openrouter/x",
    }
    df = spark.createDataFrame([(k,) for k in names], "m string").select("m", dims.normalise_model("m").alias("n"))
    assert {r.m: r.n for r in df.collect()} == names


def test_provider(spark):
    names = {"claude-x": "anthropic", "o1": "openai", "o3-mini": "openai", "o5": "unknown", "gpt-5": "openai", "gemini-3": "google", "llama3": "meta", "grok": "xai", "qwen2": "qwen", "command-r": "cohere", "unknown": "unknown"}
    df = spark.createDataFrame([(k,) for k in names], "m string").select("m", dims.provider(F.col("m")).alias("p"))
    assert {r.m: r.p for r in df.collect()} == names


def test_scans_skip_bad_lines(spark, tmp_path):
    good = {"source": "a", "model": "m", "hour_start": "2026-04-20T12:00:00.000Z", "device_id": "d", "total_tokens": 5}
    path = tmp_path / "queue.jsonl"
    path.write_text(json.dumps(good) + "\n\nnot json\n" + json.dumps(good | {"hour_start": "bad"}) + "\n")
    rows = logs.read_usage(spark, str(path))
    assert rows.count() == 2 and cells.rows(rows).count() == 1
    assert logs.read_usage(spark, str(tmp_path / "none.jsonl")).count() == 0
    keyless = tmp_path / "s.jsonl"
    keyless.write_text('{"session_key": "k", "snapshot_at": "2026-04-20T12:00:00.000Z"}\n{"source": "x"}\n')
    assert logs.read_session_snapshots(spark, str(keyless)).count() == 1


def test_since(spark):
    now = datetime(2026, 4, 20, 12, tzinfo=UTC)
    assert logs.since_of("24h", now) == "2026-04-19T12:00:00.000Z" and logs.since_of("1m", now) == "2026-03-21T12:00:00.000Z" and logs.since_of("all", now) is None
    with pytest.raises(ValueError):
        logs.since_of("soon", now)


def test_latest_sessions(spark):
    s = sessions(spark, ("k", "a", "2026-04-20T10:00:00", "2026-04-20T10:01:00", 1, 1), ("k", "a", "2026-04-20T10:00:00", "2026-04-20T10:05:00", 2, 2))
    assert one(logs.latest_sessions(s))["total_messages"] == 4


def test_empty_inputs(spark):
    u, s = usage(spark), sessions(spark)
    for df in (
        totals.digest(u), totals.agent_mix(u), cyclic.heatmap_summary(u, 20000), cyclic.source_dead_hours(u), distribution.token_deciles(u), distribution.tail_share(u), tenure.tenure(u), tenure.active_span_summary(u),
        series.anomalies(u, 20000), series.velocity_summary(u, 20000 * 86400), sequence.bucket_handoff_summary(u), sequence.session_gaps_summary(s), sequence.session_concurrency(s), sequence.source_run_lengths(s),
    ):
        df.collect()
    assert totals.digest(u).count() == 0


def test_digest_counts_zero_rows(spark):
    u = usage(spark, ("2026-04-20T12:00:00", 0, "", "opus"), ("2026-04-20T12:30:00", 7, None, ""), (None, 9, "a", "m"))
    assert one(totals.digest_by(u, "source")) == {"key": "unknown", "total_tokens": 7, "input_tokens": 7, "output_tokens": 0, "reasoning_tokens": 0, "cached_input_tokens": 0, "events": 2}


def test_cost(spark):
    u = usage(spark, ("2026-04-20T12:00:00", 3_000_000, "a", "gpt-5.4", 1_000_000, 1_000_000, 1_000_000, 0), ("2026-04-20T12:00:00", 5, "a", "mystery"))
    c = one(totals.cost_summary(u, dims.rates(spark)))
    assert c == {"total_cost": 20.5, "total_cost_no_cache": 25.0, "cache_savings": 4.5}
    assert one(totals.cost_unknown_models(u, dims.rates(spark))) == {"model": "mystery", "events": 1, "total_tokens": 5}


def test_attribution_splits_by_messages(spark):
    u = usage(spark, ("2026-04-20T12:00:00", 100, "a", "m"), ("2026-04-20T12:00:00", 40, "b", "m"))
    s = sessions(spark, ("k1", "a", "2026-04-20T10:00:00", "2026-04-20T11:00:00", 1, 2), ("k2", "a", "2026-04-20T10:00:00", "2026-04-20T11:00:00", 1, 0))
    s = s.withColumn("project_ref", F.when(F.col("session_key") == "k1", "p1").otherwise("p2"))
    rows = {(r.project_ref, r.source): r.tokens for r in totals.project_attribution(u, s).collect()}
    assert rows == {("p1", "a"): 75, ("p2", "a"): 25, ("p1", None): 75, ("p2", None): 25}
    assert one(totals.project_unattributed(u, s)) == {"unattributed_tokens": 40}


def test_cache_ratios_differ(spark):
    u = usage(spark, ("2026-04-20T12:00:00", 30, "a", "m", 10, 20, 0, 0))
    assert totals.cache_hit_ratio(u).where("source is null").first()["hit_ratio"] == 2.0
    assert totals.cache_hit_extremes(u).first()["cache_ratio"] == 1.0
    assert totals.cache_hit_by_hour(u).count() == 48


def test_welch(spark):
    u = usage(spark, ("2026-04-20T12:00:00", 10, "a", "m"), ("2026-04-21T12:00:00", 14, "a", "m"), ("2026-04-18T12:00:00", 2, "a", "m"))
    r = one(totals.compare_windows(u, (20563, 20565), (20561, 20563)))
    assert (r["a_tokens"], r["b_tokens"], r["delta"], r["pct"]) == (24, 2, 22, 11.0)
    assert r["t"] == pytest.approx(11 / (8 / 2 + 2 / 2) ** 0.5) and r["hint"] == "significant"


def test_circular_runs(spark):
    rows = [(f"2026-04-20T{h:02d}:00:00", 1000, "a", "m") for h in (22, 23, 0, 1, 5)]
    u = usage(spark, *rows)
    run = one(cyclic.source_active_hour_longest_run(u))
    assert (run["longest_active_run"], run["active_run_count"], run["longest_run_start"]) == (4, 2, 22)
    dead = one(cyclic.source_dead_hours(u))
    assert (dead["dead_hours"], dead["longest_dead_run"], dead["dead_run_count"]) == (19, 16, 2)
    span = one(cyclic.source_active_hour_span(u))
    assert (span["circular_span"], span["span_start_hour"], span["span_end_hour"], span["largest_quiet_gap"]) == (8, 22, 5, 16)


def test_single_and_full_hours(spark):
    lone, full = usage(spark, ("2026-04-20T07:00:00", 1000, "a", "m")), usage(spark, *[(f"2026-04-20T{h:02d}:00:00", 1000, "a", "m") for h in range(24)])
    assert one(cyclic.source_active_hour_span(lone))["circular_span"] == 1 and one(cyclic.source_active_hour_span(full))["circular_span"] == 24
    assert one(cyclic.source_active_hour_longest_run(full))["longest_active_run"] == 24 and one(cyclic.source_dead_hours(full))["dead_run_count"] == 0


def test_deciles_partition_the_rows(spark):
    u = usage(spark, *[("2026-04-20T12:00:00", i + 1, "a", "m") for i in range(23)], *[("2026-04-20T12:00:00", 5, "a", "m")] * 4)
    d = {r.decile: r.bucket_count for r in distribution.token_deciles(u).collect()}
    assert d == {i: 3 if i <= 7 else 2 for i in range(1, 11)}
    p = {r.decile: r["count"] for r in distribution.bucket_density_deciles(u).collect()}
    assert p == {i: 27 * i // 10 - 27 * (i - 1) // 10 for i in range(1, 11)}


def test_value_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (5, 1, 5, 1000, 7, 1)], "v long")
    assert {r.v: (r.n, r.before) for r in stats.value_ranks(df, "v").collect()} == {1: (2, 0), 5: (2, 2), 7: (1, 4), 1000: (1, 5)}


def test_gini_bounds(spark):
    equal, lone = usage(spark, *[(f"2026-04-20T{h:02d}:00:00", 10, "a", "m") for h in range(5)]), usage(spark, ("2026-04-20T01:00:00", 10, "a", "m"))
    assert one(distribution.bucket_token_gini(equal))["gini"] == 0 and one(distribution.bucket_token_gini(lone))["gini"] == 0


def test_flat_days_and_anomaly(spark):
    u = usage(spark, *[(f"2026-04-{d:02d}T12:00:00", 10, "a", "m") for d in range(1, 9)], ("2026-04-09T12:00:00", 12, "a", "m"))
    a = {r.day: r.status for r in series.anomalies(u, 20552, lookback=2).collect()}
    assert a == {"2026-04-08": "flat", "2026-04-09": "flat"}


def test_drift_carries_over_days_without_tokens(spark):
    u = usage(spark, ("2026-04-01T12:00:00", 10, "a", "m", 5, 5, 0, 0), ("2026-04-03T12:00:00", 10, "a", "m", 1, 9, 0, 0))
    d = [r for r in series.cache_ratio_drift(u, 20546, lookback=4).orderBy("dayno").collect()]
    assert [r.status for r in d] == ["undefined", "warmup", "undefined", "warmup"] and d[0].ewma is None and d[2].ewma == d[1].ewma == pytest.approx(0.5)


def test_streaks_keep_the_earlier_run(spark):
    u = usage(spark, *[(f"2026-04-{d:02d}T12:00:00", 10, "a", "m") for d in (1, 2, 5, 6)])
    s = one(series.activity_streak_summary(u, 20550, lookback=7))
    assert (s["longest_active"], s["longest_active_start"], s["active_days"], s["current_state"]) == (2, "2026-04-01", 4, "idle")
    dry = one(series.source_dry_spell(u))
    assert (dry["longest_dry_spell"], dry["longest_dry_spell_start"], dry["longest_dry_spell_end"]) == (2, "2026-04-03", "2026-04-04")


def test_half_hour_buckets(spark):
    u = usage(spark, *[(f"2026-04-20T{t}:00", 10, "a", "m") for t in ("10:00", "10:30", "11:00", "12:00")])
    s = one(series.bucket_streak_length(u))
    assert (s["active_buckets"], s["longest_streak"], s["streak_count"]) == (4, 3, 2)
    assert one(series.interarrival_time(u))["from_1h"] == 3  # half an hour rounds to 1


def test_monotone_and_second_differences(spark):
    u = usage(spark, *[(f"2026-04-{i + 1:02d}T12:00:00", v, "a", "m") for i, v in enumerate((1, 2, 3, 3, 2, 5))])
    m = one(series.daily_monotone_runs(u))
    assert (m["longest_up_run"], m["longest_down_run"], m["longest_direction"], m["current_direction"], m["current_run_length"], m["runs"]) == (3, 2, "up", "up", 2, 3)
    d = one(series.daily_second_diff_runs(u))
    assert (d["n_d2_points"], d["n_flat"], d["n_concave_down"], d["n_concave_up"], d["longest_regime"]) == (4, 1, 2, 1, "concavedown")


def test_autocorrelation_fills_gaps(spark):
    u = usage(spark, ("2026-04-01T12:00:00", 3, "a", "m"), ("2026-04-02T12:00:00", 1, "a", "m"), ("2026-04-05T12:00:00", 5, "a", "m"))
    r = one(series.daily_autocorr_lag1(u))
    filled = [3, 1, 0, 0, 5]
    mu = sum(filled) / 5
    want = sum((a - mu) * (b - mu) for a, b in zip(filled, filled[1:])) / sum((a - mu) ** 2 for a in filled)
    assert r["rho1_filled"] == pytest.approx(want) and r["rho1_active"] == pytest.approx((0 * -2 + -2 * 2) / 8)


def test_sessions_touching_do_not_overlap(spark):
    s = sessions(spark, ("a", "x", "2026-04-20T10:00:00", "2026-04-20T11:00:00", 1, 1), ("b", "x", "2026-04-20T11:00:00", "2026-04-20T12:00:00", 1, 1), ("c", "y", "2026-04-20T23:30:00", "2026-04-21T00:30:00", 1, 1), ("d", "y", "2026-04-21T00:00:00", "2026-04-21T00:10:00", 1, 1))
    c = one(sequence.session_concurrency(s))
    assert c["peak_concurrency"] == 2 and c["peak_duration_ms"] == 600_000 and c["peak_at"] == "2026-04-21T00:00:00.000Z"
    assert {r.session_key for r in sequence.concurrency_peak_sessions(s).collect()} == {"c", "d"}
    runs = {r.source: (r.run_count, r.max_run_length) for r in sequence.source_run_lengths(s).collect()}
    assert runs == {"x": (1, 2), "y": (1, 2)}
    t = {(r["from"], r["to"]): (r["count"], r["overlap_count"]) for r in sequence.session_transitions(s).collect()}
    assert t == {("x", "x"): (1, 0), ("y", "y"): (1, 1)}


def test_model_switching_counts_returns(spark):
    rows = [("k", "a", "2026-04-20T10:00:00", "2026-04-20T11:00:00", 1, 1, m, f"2026-04-20T10:0{i}:00") for i, m in enumerate(("A", "B", "B", "A"))]
    s = one(sequence.model_switching(sessions(spark, *rows)))
    assert (s["considered_sessions"], s["switched_sessions"], s["total_transitions"], s["max_distinct_models"]) == (1, 1, 2, 2)


def test_binned_edges_are_inclusive(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (60, 61, 300, 99999)], "group string, x double")
    assert [r["count"] for r in stats.binned(df, "group", "x", (60, 300)).orderBy("bin_index").collect()] == [1, 2, 1]


def test_same_result_under_many_partitions(spark, sf):
    from meterlark.sources import adapter

    want = sorted(map(str, sequence.source_run_lengths(adapter.sessions(spark, sf)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert sorted(map(str, sequence.source_run_lengths(adapter.sessions(spark, sf)).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_retention(spark):
    df = spark.createDataFrame([("1", "a", "succeeded"), ("2", "a", "succeeded"), ("3", "b", "failed"), ("4", "b", "skipped")], "name string, day string, status string")
    assert {r.name for r in sequence.runs_retention(df, keep=1).collect()} == {"1", "3"}


def test_runs_folder(spark, tmp_path):
    for i in (1, 2, 3):
        (tmp_path / f"2026-04-0{i}.json").write_text(json.dumps({"runId": str(i), "status": "succeeded"}, indent=1))
    (tmp_path / "2026-04-09.json").write_text("{ not json")
    assert [r.runId for r in logs.read_runs(spark, str(tmp_path), limit=2).orderBy("name").collect()] == ["2", "3"]
    assert logs.read_runs(spark, str(tmp_path), since="2026-04-03").count() == 1 and logs.read_runs(spark, str(tmp_path / "none")).count() == 0


def test_drop_counters_name_the_first_reason(spark):
    u = usage(spark, (None, 0, "a", "m"), ("2026-04-20T12:00:00", 0, "b", "m"), ("2026-04-20T12:00:00", 1, "b", "m"), ("2026-04-20T12:00:00", 1, "a", "x"), ("2026-04-20T12:00:00", 1, "a", "m"))
    assert list(one(cells.drops(u, source="a", model="m")).values()) == [1, 1, 1, 1, 1]


def test_percentiles_by_ranks(spark):
    values = {"a": [-3.5, -1.0, 0.0, 0.0, 2.25, 2.5, 7.0], None: [1.0, 1e9], "nulls": [None], "b": [4.0]}
    rows = [(g, float(v) if v is not None else None) for g, vs in values.items() for v in vs + [None]]
    df = spark.createDataFrame(rows, "g string, v double")
    quantiles = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {tuple(r) for r in stats.percentiles(df, ["g"], "v", quantiles).collect()}
    expected = {tuple(r) for r in df.where("v is not null").groupBy("g").agg(*[stats.nearest("v", q).alias(n) for n, q in quantiles.items()]).collect()}
    assert got == expected
    assert [tuple(r) for r in stats.percentiles(df.where("false"), [], "v", {"p50": 0.5}).collect()] == [(None,)]
