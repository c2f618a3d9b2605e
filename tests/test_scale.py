"""Hot keys and crowded hours: results against plain lists, and how the work is parted."""

from __future__ import annotations

import random
from collections import Counter
from datetime import UTC, datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from test_logs import sessions, usage

from meterlark.functions import order, storage
from meterlark.operators import distribution, sequence, series, tenure
from meterlark.sources import logs

START = datetime(2026, 4, 20, tzinfo=UTC)


def iso(seconds):
    return (START + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S")


@pytest.fixture
def many_parts(monkeypatch):
    """Every order in a dozen ranges, however few the rows."""
    numbered = order.numbered
    monkeypatch.setattr(order, "numbered", lambda df, *keys, parts=None: numbered(df, *keys, parts=12))


@pytest.fixture(scope="module")
def one_day(spark):
    """Sessions that all start on one day, many at one time."""
    r = random.Random(1)
    rows = []
    for i in range(600):
        a = r.choice([3600, r.randrange(80_000)])
        rows.append((f"k{i:04d}", r.choice("aab"), a, a + r.randrange(1, 4000)))
    df = sessions(spark, *[(k, s, iso(a), iso(b), 1, 1) for k, s, a, b in rows])
    return storage.written(df), sorted(rows, key=lambda x: (x[2], x[0]))


def test_one_day_of_sessions_is_many_parts(spark, one_day):
    df, rows = one_day
    o = order.numbered(df.select("session_key", F.unix_micros("started_at").alias("t")), "t", "session_key", parts=12)
    sizes = [r["count"] for r in o.groupBy("_part").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < len(rows) / 4


def test_gaps_runs_and_transitions_over_parts(spark, one_day, many_parts):
    df, rows = one_day
    gaps = [max(0, b[2] - a[3]) for a, b in zip(rows, rows[1:], strict=False)]
    s = sequence.session_gaps_summary(df).first()
    assert s["total_sessions"] == 600 and s["max_gap_seconds"] == max(gaps) and s["median_gap_seconds"] == sorted(gaps)[len(gaps) // 2]
    runs, last = [], None
    for _, source, _, _ in rows:
        if source == last:
            runs[-1] += 1
        else:
            runs.append(1)
        last = source
    g = sequence.source_run_lengths_global(df).first()
    assert g["run_count"] == len(runs) and g["max_run_length"] == max(runs) and g["session_count"] == 600
    pairs = Counter((a[1], b[1]) for (a, b), gap in zip(zip(rows, rows[1:], strict=False), gaps, strict=True) if gap <= 1800)
    assert {(r["from"], r["to"]): r["count"] for r in sequence.session_transitions(df).collect()} == dict(pairs)


def test_concurrency_over_parts(spark, one_day, many_parts):
    df, rows = one_day
    net = Counter()
    for _, _, a, b in rows:
        net[a] += 1
        net[b] -= 1
    times, level, spent = sorted(net), 0, Counter()
    peak = (0, 0)
    for t, after in zip(times, [*times[1:], None], strict=True):
        level += net[t]
        peak = max(peak, (level, -t))
        if after:
            spent[level] += after - t
    c = sequence.session_concurrency(df).first()
    assert c["peak_concurrency"] == peak[0] and c["peak_at"].startswith(iso(-peak[1])) and c["peak_duration_ms"] == spent[peak[0]] * 1000
    assert {r["level"]: r["total_ms"] for r in sequence.concurrency_histogram(df).collect()} == {k: v * 1000 for k, v in spent.items()}
    plan = sequence.session_concurrency(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "day" not in plan


def test_one_session_of_many_snapshots(spark, many_parts):
    r = random.Random(2)
    rows, seconds = [], 0
    for _ in range(800):
        seconds += r.randrange(1, 500)
        rows.append(("hot", seconds, r.choice(["m1", "m1", "m2"])))
    rows += [("cold", 5, "m1"), ("cold", 9, "m2"), ("one", 7, "m1")]
    df = sessions(spark, *[(k, "s", iso(0), iso(t), 1, 1, m, iso(t)) for k, t, m in r.sample(rows, len(rows))])
    hot = [x for x in rows if x[0] == "hot"]
    gaps = [b[1] - a[1] for a, b in zip(hot, hot[1:], strict=False)] + [4]
    found = sequence.idle_gaps(df, by="source")
    assert sorted(r.x for r in found.collect()) == sorted(map(float, gaps)) and found.where("group = 's'").count() == len(gaps)
    hops = Counter((a[2], b[2]) for a, b in zip(hot, hot[1:], strict=False) if a[2] != b[2]) + Counter({("m1", "m2"): 1})
    assert {(r["from"], r["to"]): r["count"] for r in sequence.model_switch_pairs(df).collect()} == dict(hops)
    assert sequence.model_switching(df).first()["considered_sessions"] == 3


def test_latest_session_of_a_hot_key_is_one_aggregate(spark):
    df = sessions(spark, *[("hot", "s", iso(0), iso(i), i, 1) for i in range(300)])
    latest = logs.latest_sessions(df)
    assert latest.first()["user_messages"] == 299
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") >= 2


def test_five_thousand_names_of_one_hour(spark):
    """The rare ones never meet: what the join makes is bounded by the frequent ones."""
    rows = [(iso(3600 * h), 5, s, "m") for h in range(30) for s in ("a", "b", "c")[: 2 + (h % 3 == 0)]]
    rows += [(iso(0), 5, f"rare{i}", "m") for i in range(5000)]
    u = usage(spark, *rows)
    got = [(r.a, r.b, r["count"]) for r in sequence.source_pair_cooccurrence(u, top=3).collect()]
    assert got == [("a", "b", 30), ("a", "c", 10), ("b", "c", 10)]
    every = sum(k * (k - 1) // 2 for k in Counter(t for t, *_ in rows).values())
    assert abs(sequence.source_pair_cooccurrence(u, top=1).first()["share"] - 30 / every) < 1e-12
    b = sequence.cells.buckets(u, "source")
    n = b.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    assert sequence._paired(b, n, "source", sequence._least_of_top(b, n, "source", 3, 1, 0.0)).count() == 50
    models = usage(spark, *[(t, 5, "s", m) for t, _, m, _ in rows[:400]])
    assert {(r.model_a, r.model_b) for r in sequence.model_cohabitation(models, 2).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


@pytest.mark.parametrize("seed", range(3))
def test_pairs_against_brute_force(spark, seed):
    r = random.Random(seed)
    cells = sorted({(r.randrange(12), r.choice("abcdefgh")) for _ in range(60)})
    u = usage(spark, *[(iso(3600 * h), 5, s, s) for h, s in cells])
    by, n = Counter(), Counter(s for _, s in cells)
    for h in range(12):
        by.update(combinations(sorted(s for x, s in cells if x == h), 2))
    want = [(a, b, c) for (a, b), c in by.items() if c >= 2 and c / (n[a] + n[b] - c) >= 0.3]
    want.sort(key=lambda x: (-x[2], -x[2] / (n[x[0]] + n[x[1]] - x[2]), x[0], x[1]))
    got = sequence.source_pair_cooccurrence(u, min_count=2, min_jaccard=0.3, top=5).collect()
    assert [(x.a, x.b, x["count"]) for x in got] == want[:5]
    of = {(x.model_a, x.model_b): x.co_buckets for x in sequence.model_cohabitation(u, by_model="c").collect()}
    assert of == {k: c for k, c in by.items() if "c" in k}


@pytest.mark.parametrize("alpha", [0.3, 0.05, 0.999, 1.0])
def test_smoothing_has_its_closed_form(spark, alpha):
    r = random.Random(5)
    xs = [None, None] + [r.choice([None, r.uniform(-9, 9)]) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(xs)), "dayno long, x double")
    got = {x.dayno: x.logit for x in series.smoothed(d, "x", alpha).collect()}
    value = None
    for k, x in enumerate(xs):
        value = value if x is None else x if value is None else alpha * x + (1 - alpha) * value
        assert (got[k] is None) == (value is None) and (value is None or abs(got[k] - value) < 1e-9)
    assert "collect_list" not in series.smoothed(d, "x", alpha)._jdf.queryExecution().optimizedPlan().toString()


def test_counters_come_with_the_rows(spark):
    rows = [(iso(3600 * h), 5, "a", "m") for h in range(4)] + [(iso(0), 5, "a", "few"), (iso(0), 0, "a", "m"), (None, 9, "a", "m"), (iso(0), 9, "b", "m"), ("2025-01-01T00:00:00", 9, "a", "m")]
    u = usage(spark, *rows)
    window = {"since": "2026-01-01T00:00:00Z", "source": "a"}
    [r] = series.bucket_streak_length_counted(u, min_buckets=2, **window).collect()
    assert (r.model, r.longest_streak, r.dropped_invalid_hour_start, r.dropped_zero_tokens, r.dropped_source_filter, r.dropped_below_min_buckets) == ("m", 4, 1, 1, 1, 1)
    [r] = series.bucket_streak_length_counted(u, min_buckets=9, **window).collect()
    assert r.model is None and r.dropped_below_min_buckets == 2
    [r] = distribution.rolling_bucket_cv_counted(u, window_size=3, min_window_cv=0.5, **window).collect()
    assert (r.source, r.dropped_low_cv_windows, r.dropped_all_windows_floored, r.dropped_sparse_sources) == (None, 2, 1, 0)
    [r] = tenure.cumulative_tokens_midpoint_counted(u, min_days=2, **window).collect()
    assert (r.source, r.dropped_below_min_days, r.dropped_zero_tokens) == (None, 1, 1)
