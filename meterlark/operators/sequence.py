"""Pairs, hand-offs, switches and intervals of sessions; retention of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, dims, order, stats, storage

HOUR = 3600
# Edges of the gaps inside a session, in seconds.
IDLE_EDGES = (60, 300, 1800, 3600, 14400, 86400)


#: Names whose pairs give the first bound on a list of the largest counts.
HEADS = 64


def _paired(b: DataFrame, n: DataFrame, key: str, least: int, min_jaccard: float = 0.0, only: str | None = None) -> DataFrame:
    """Pairs of names of one bucket, row by row of the join: (a, b, na, nb, ta, tb).

    A pair's count is at most the smaller of its names' counts, and its Jaccard at most their ratio: names
    below ``least`` buckets never reach the join, and pairs too unlike in their counts leave it uncounted.
    ``only``: a name that all pairs hold.
    """
    held = b.join(n.where(F.col("n") >= least), key)
    x = held.select(F.col(key).alias("a"), "sec", F.col("n").alias("na"), F.col("tokens").alias("ta"))
    y = held.select(F.col(key).alias("b"), "sec", F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    like = (F.least("na", "nb") >= min_jaccard * F.greatest("na", "nb")) if min_jaccard > 0 else F.lit(True)
    if only is None:
        return x.join(y, "sec").where((F.col("a") < F.col("b")) & like)
    first = x.where(F.col("a") == only).join(y, "sec").where((F.col("b") > only) & like)
    return first.unionByName(x.join(y.where(F.col("b") == only), "sec").where((F.col("a") < only) & like))


def _least_of_top(b: DataFrame, n: DataFrame, key: str, top: int, min_count: int, min_jaccard: float) -> int:
    """A count that the ``top`` pairs by count all reach: the last of the best pairs among the most frequent names."""
    heads = n.orderBy(F.desc("n"), key).limit(max(HEADS, 2 * top))
    counts = _jaccards(_paired(b, heads, key, min_count, min_jaccard)).where((F.col("count") >= min_count) & (F.col("jaccard") >= min_jaccard))
    best = counts.select("count").orderBy(F.desc("count")).limit(top).agg(F.count(F.lit(1)).alias("k"), F.min("count").alias("c")).first()
    return max(min_count, best["c"]) if best["k"] == top else min_count


def _jaccards(pairs: DataFrame) -> DataFrame:
    g = pairs.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("count"), F.sum(F.least("ta", "tb")).alias("co_tokens"))
    return g.withColumn("jaccard", F.col("count") / (F.col("na") + F.col("nb") - F.col("count")))


def source_pair_cooccurrence(usage: DataFrame, min_count: int = 1, min_jaccard: float = 0.0, top: int = 10, **window) -> DataFrame:
    """Pairs of sources active in one bucket: count, Jaccard, share of all pairs. Rows without a source go.

    Only sources that the pairs of the most frequent ones don't exclude from the list are paired, so many rare
    sources of one hour cost nothing; the number of all pairs comes from the buckets' sizes.
    """
    b = storage.written(cells.buckets(usage.where("source is not null and source <> ''"), "source", **window))
    n = b.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    least = _least_of_top(b, n, "source", top, max(1, min_count), min_jaccard)
    every = b.groupBy("sec").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("every"))
    p = _jaccards(_paired(b, n, "source", least, min_jaccard)).where((F.col("count") >= min_count) & (F.col("jaccard") >= min_jaccard))
    p = p.crossJoin(F.broadcast(every)).withColumn("share", F.col("count") / F.col("every"))
    return p.select("a", "b", "count", "jaccard", "share").orderBy(F.desc("count"), F.desc("jaccard"), "a", "b").limit(top)


def model_cohabitation(usage: DataFrame, min_co_buckets: int = 0, by_model: str | None = None, **window) -> DataFrame:
    """Pairs of models active in one bucket, with the smaller of their tokens; ``by_model`` keeps the pairs of one model."""
    b = cells.buckets(usage, "model", **window)
    n = b.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    p = _jaccards(_paired(b, n, "model", min_co_buckets, only=by_model)).where(F.col("count") >= min_co_buckets)
    co = F.col("count")
    return p.select(
        F.col("a").alias("model_a"), F.col("b").alias("model_b"), co.alias("co_buckets"), "co_tokens", F.col("jaccard").alias("cohab_index"),
        (co / F.col("na")).alias("co_share_a"), (co / F.col("nb")).alias("co_share_b"),
    )


def model_cohabitation_models(usage: DataFrame, **window) -> DataFrame:
    b = cells.buckets(usage, "model", **window)
    p = model_cohabitation(usage, **window)
    ends = p.select(F.col("model_a").alias("m")).unionByName(p.select(F.col("model_b").alias("m"))).groupBy("m").agg(F.count(F.lit(1)).alias("k"))
    g = b.groupBy("model").agg(F.count(F.lit(1)).alias("buckets_active"), F.sum("tokens").alias("tokens"))
    return g.join(ends, F.col("model") == F.col("m"), "left").withColumn("distinct_cohabitants", F.coalesce("k", F.lit(0)))


def _primary(usage: DataFrame, by: str, **window) -> DataFrame:
    """The model or source with the most tokens of each bucket (first by name of equals), with the bucket before."""
    b = cells.buckets(usage, by, **window).where(F.col(by) != "")
    g = b.groupBy("sec").agg(F.min(F.struct((-F.col("tokens")).alias("n"), F.col(by).alias("k"))).alias("x"))
    p = g.select("sec", F.floor(F.col("sec") / 86400).alias("dayno"), F.col("x.k").alias("key"), (-F.col("x.n")).alias("tokens"))
    return stats.previous_cell(p, "dayno", ["sec"])


def _changes(p: DataFrame) -> DataFrame:
    return p.where(F.col("prev").isNotNull() & (F.col("prev.key") != F.col("key"))).select(F.col("prev.key").alias("from"), F.col("key").alias("to"), ((F.col("sec") - F.col("prev.sec")) / HOUR).alias("hours"), "dayno", F.col("prev.dayno").alias("prev_day"))


def bucket_handoff(usage: DataFrame, top: int = 10, min_handoffs: int = 1, **window) -> DataFrame:
    """Directed changes of the primary model from bucket to bucket."""
    c = _changes(_primary(usage, "model", **window)).groupBy("from", "to").agg(F.count(F.lit(1)).alias("count"))
    return c.where(F.col("count") >= min_handoffs).orderBy(F.desc("count"), "from", "to").limit(top)


def _stickiest(p: DataFrame):
    return p.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("t")).alias("t"), "key")).alias("s"))


def bucket_handoff_summary(usage: DataFrame, **window) -> DataFrame:
    p = _primary(usage, "model", **window)
    pair, next_hour = F.col("prev").isNotNull(), F.col("sec") - F.col("prev.sec") == HOUR
    change = pair & (F.col("prev.key") != F.col("key"))
    s = p.agg(F.count(F.lit(1)).alias("active_buckets"), F.count_if(pair).alias("considered_pairs"), F.count_if(change).alias("handoff_pairs"), F.count_if(pair & next_hour).alias("contiguous_pairs"), F.count_if(change & next_hour).alias("contiguous_handoffs"))
    out = s.crossJoin(_stickiest(p))
    return out.select("*", stats.ratio("handoff_pairs", "considered_pairs").alias("handoff_share"), (F.col("considered_pairs") - F.col("contiguous_pairs")).alias("gapped_pairs"), (F.col("handoff_pairs") - F.col("contiguous_handoffs")).alias("gapped_handoffs"), F.col("s.key").alias("stickiest_model"), (-F.col("s.n")).alias("stickiest_model_buckets"))


def source_handoff_latency(usage: DataFrame, top: int = 10, min_handoffs: int = 1, max_hours: float | None = None, **window) -> DataFrame:
    """Hours from bucket to bucket at each change of the primary source."""
    c = _changes(_primary(usage.where("source is not null and source <> ''"), "source", **window))
    c = c.where(F.col("hours") <= max_hours) if max_hours is not None else c
    g = c.groupBy("from", "to").agg(F.count(F.lit(1)).alias("count"), stats.linear("hours", 0.5).alias("median_latency_hours"), F.min("hours").alias("min_latency_hours"), F.max("hours").alias("max_latency_hours"))
    return g.where(F.col("count") >= min_handoffs).orderBy(F.desc("count"), "from", "to").limit(top)


def source_handoff_summary(usage: DataFrame, max_hours: float | None = None, **window) -> DataFrame:
    """A cap on the latency takes hand-offs away, not considered pairs."""
    p = _primary(usage.where("source is not null and source <> ''"), "source", **window)
    c = _changes(p)
    c = c.where(F.col("hours") <= max_hours) if max_hours is not None else c
    s = c.agg(F.count(F.lit(1)).alias("handoff_pairs"), stats.linear("hours", 0.5).alias("median_latency_hours"), F.avg("hours").alias("mean_latency_hours"), F.min("hours").alias("min_latency_hours"), F.max("hours").alias("max_latency_hours"), F.count_if(F.col("hours") == 1).alias("contiguous_handoffs"))
    n = p.agg(F.count(F.lit(1)).alias("active_buckets"), F.count("prev").alias("considered_pairs"))
    out = n.crossJoin(s).crossJoin(_stickiest(p))
    return out.select("*", stats.ratio("handoff_pairs", "considered_pairs").alias("handoff_share"), (F.col("handoff_pairs") - F.col("contiguous_handoffs")).alias("gapped_handoffs"), F.col("s.key").alias("dominant_source"), (-F.col("s.n")).alias("dominant_source_buckets"))


def _providers(usage: DataFrame, **window) -> DataFrame:
    p = _primary(usage, "model", **window).withColumns({"provider": dims.provider(F.col("key")), "before": F.when(F.col("prev").isNotNull(), dims.provider(F.col("prev.key")))})
    return p.withColumns({"same_day": F.col("prev.dayno") == F.col("dayno"), "switch": F.col("before") != F.col("provider")})


def provider_switching_pairs(usage: DataFrame, top: int = 10, min_switches: int = 1, **window) -> DataFrame:
    """Directed changes of the primary model's provider within a day."""
    g = _providers(usage, **window).where("same_day and switch").groupBy(F.col("before").alias("from"), F.col("provider").alias("to")).agg(F.count(F.lit(1)).alias("count"))
    return g.where(F.col("count") >= min_switches).orderBy(F.desc("count"), "from", "to").limit(top)


def provider_switching_days(usage: DataFrame, **window) -> DataFrame:
    p = _providers(usage, **window)
    g = p.groupBy("dayno").agg(F.count(F.lit(1)).alias("active_buckets"), F.count_if(F.col("same_day")).alias("considered_pairs"), F.count_if(F.col("same_day") & F.col("switch")).alias("switch_pairs"))
    d = p.groupBy("dayno", "provider").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).groupBy("dayno").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("t")).alias("t"), "provider")).alias("x"))
    return g.join(d, "dayno").select(dims.day_of(F.col("dayno")).alias("day"), "active_buckets", "considered_pairs", "switch_pairs", stats.ratio("switch_pairs", "considered_pairs").alias("switch_share"), F.col("x.provider").alias("dominant_provider"), (-F.col("x.n")).alias("dominant_provider_buckets"))


def provider_switching_summary(usage: DataFrame, **window) -> DataFrame:
    cross = ~F.col("same_day")
    p = _providers(usage, **window)
    s = p.agg(
        F.countDistinct("dayno").alias("active_days"), F.count(F.lit(1)).alias("active_buckets"), F.count_if(F.col("same_day")).alias("considered_pairs"), F.count_if(F.col("same_day") & F.col("switch")).alias("switch_pairs"), F.count_if(cross).alias("cross_day_pairs"),
        F.count_if(cross & F.col("switch")).alias("cross_day_switches"), F.countDistinct(F.when(F.col("same_day") & F.col("switch"), F.col("dayno"))).alias("days_with_any_switch"),
    )
    return s.withColumns({"switch_share": stats.ratio("switch_pairs", "considered_pairs"), "mean_switches_per_active_day": stats.ratio("switch_pairs", "active_days"), "day_coverage": stats.ratio("days_with_any_switch", "active_days")})


def _ordered(sessions: DataFrame, since=None, until=None) -> DataFrame:
    """Sessions in one order by (start, key), each with the session before it."""
    s = dims.within(sessions.where("started_at is not null"), "started_at", since, until)
    s = dims.effective_end(s).withColumns({"last_ms": dims.epoch_milli("last_message_at"), "source": dims.or_unknown("source")})
    s = s.select("session_key", "source", "kind", "project_ref", "start_ms", "end_ms", "last_ms")
    return order.with_previous(s, "start_ms", "session_key")


def _gap_rows(sessions: DataFrame, **window) -> DataFrame:
    gap = F.greatest(F.lit(0), F.floor((F.col("start_ms") - F.col("prev.last_ms")) / 1000))
    return _ordered(sessions, **window).where("prev is not null").withColumn("gap", gap)


def session_gaps_summary(sessions: DataFrame, quantile: float = 0.9, **window) -> DataFrame:
    g = _gap_rows(sessions, **window)
    s = g.agg((F.count(F.lit(1)) + 1).alias("total_sessions"), F.count(F.lit(1)).alias("total_gaps"), F.max("gap").alias("max_gap_seconds"))
    s = s.crossJoin(stats.percentiles(g, [], "gap", {"threshold_seconds": quantile}, {"median_gap_seconds": 0.5}))
    at = g.groupBy(F.col("gap").alias("threshold_seconds")).agg(F.count(F.lit(1)).alias("gaps_at_threshold"))
    return s.join(at, "threshold_seconds", "left")


def session_gaps(sessions: DataFrame, quantile: float = 0.9, min_gap: int = 0, top: int = 10, **window) -> DataFrame:
    """The longest gaps above the quantile, with their mid-rank among all gaps."""
    g = _gap_rows(sessions, **window)
    limit = stats.percentiles(g, [], "gap", {"limit": quantile}).crossJoin(g.agg(F.count(F.lit(1)).alias("all")))
    kept = g.crossJoin(F.broadcast(limit)).where((F.col("gap") > F.col("limit")) & (F.col("gap") >= min_gap))
    first = kept.select(F.col("prev.session_key").alias("before_key"), F.col("session_key").alias("after_key"), F.col("prev.start_ms").alias("s"), "gap", "all").orderBy(F.desc("gap"), "s", "before_key").limit(top)
    ranks = stats.value_ranks(g, "gap").withColumnRenamed("gap", "_gap")
    return first.join(ranks, F.col("gap") == F.col("_gap")).select("before_key", "after_key", F.col("gap").alias("gap_seconds"), ((F.col("before") + 0.5 * F.col("n")) / F.col("all")).alias("quantile_rank"))


def _handoffs(sessions: DataFrame, max_gap: int, by: str, **window) -> DataFrame:
    raw = F.col("start_ms") - F.col("prev.end_ms")
    r = _ordered(sessions, **window).where("prev is not null").withColumns({"raw": raw, "gap": F.greatest(F.lit(0), raw), "from": F.col(f"prev.{by}"), "to": F.col(by)})
    return r.where(F.col("gap") <= max_gap * 1000)


def session_transitions(sessions: DataFrame, max_gap: int = 1800, by: str = "source", min_count: int = 0, **window) -> DataFrame:
    """Sessions that follow each other within ``max_gap`` seconds."""
    h = _handoffs(sessions, max_gap, by, **window)
    g = h.groupBy("from", "to").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("raw") < 0).alias("overlap_count"))
    q = stats.percentiles(h, ["from", "to"], "gap", {"p95_gap_ms": 0.95}, {"median_gap_ms": 0.5})
    # A group of a mix may be null.
    q = q.withColumnsRenamed({"from": "_from", "to": "_to"})
    g = g.join(q, F.col("from").eqNullSafe(F.col("_from")) & F.col("to").eqNullSafe(F.col("_to"))).drop("_from", "_to")
    return g.where(F.col("count") >= min_count)


def session_stickiness(sessions: DataFrame, max_gap: int = 1800, by: str = "source", **window) -> DataFrame:
    g = _handoffs(sessions, max_gap, by, **window).groupBy(F.col("from").alias("group")).agg(F.count(F.lit(1)).alias("outgoing"), F.count_if(F.col("from") == F.col("to")).alias("self_loop"))
    return g.withColumn("stickiness", F.col("self_loop") / F.col("outgoing"))


def _levels(sessions: DataFrame, since=None, until=None) -> DataFrame:
    """(ms, next_ms, level): number of open sessions from one event to the next.

    Starts and ends at one time are netted; the sweep runs inside ranges of time, and the level
    goes on from range to range.
    """
    s = dims.effective_end(sessions.where("started_at is not null")).where("end_ms > start_ms")
    low, high = (F.lit(x) if x is not None else None for x in (since, until))
    a = F.greatest("start_ms", low) if low is not None else F.col("start_ms")
    b = F.least("end_ms", high) if high is not None else F.col("end_ms")
    s = s.select(a.alias("a"), b.alias("b")).where("b > a")
    # One row a session, made two in the same stage: the sessions are read once.
    ends = F.explode(F.array(F.struct(F.col("a").alias("ms"), F.lit(1).alias("d")), F.struct(F.col("b").alias("ms"), F.lit(-1).alias("d"))))
    e = s.select(ends.alias("e")).groupBy(F.col("e.ms").alias("ms")).agg(F.sum("e.d").alias("d"))
    e = order.running(order.numbered(e, "ms"), [], {"level": F.col("d")})
    return order.neighbour(e, "next", ahead=True, columns=["ms"]).select("ms", F.col("next.ms").alias("next_ms"), "level")


def _by_level(levels: DataFrame) -> DataFrame:
    """(level, total_ms, first_ms): milliseconds at each number of open sessions, and when it was first reached."""
    return levels.groupBy("level").agg(F.sum(F.col("next_ms") - F.col("ms")).alias("total_ms"), F.min("ms").alias("first_ms"))


def concurrency_histogram(sessions: DataFrame, **window) -> DataFrame:
    """Milliseconds at each number of open sessions."""
    g = _by_level(_levels(sessions, **window)).where("total_ms is not null").drop("first_ms")
    return g.withColumn("fraction", F.col("total_ms") / F.sum("total_ms").over(Window.partitionBy()))


def session_concurrency(sessions: DataFrame, **window) -> DataFrame:
    """Peak, its first time and duration, mean, share of time with sessions, and 95 % quantile over time."""
    h = _by_level(_levels(sessions, **window))
    peak = F.max_by(F.struct("level", "total_ms", "first_ms"), "level")
    s = h.agg(
        F.sum("total_ms").alias("window_ms"), peak.alias("p"), F.sum(F.col("level") * F.col("total_ms")).alias("_area"),
        F.sum(F.when(F.col("level") >= 1, F.col("total_ms")).otherwise(0)).alias("_open"),
    ).where("window_ms is not null")
    q = stats.percentiles(h.where("total_ms is not null"), [], "level", {"p95_concurrency": 0.95}, weight="total_ms")
    return s.crossJoin(q).select(
        "window_ms", F.col("p.level").alias("peak_concurrency"), dims.iso_of(F.floor(F.col("p.first_ms") / 1000)).alias("peak_at"),
        F.col("p.total_ms").alias("peak_duration_ms"), (F.col("_area") / F.col("window_ms")).alias("average_concurrency"),
        (F.col("_open") / F.col("window_ms")).alias("coverage"), F.col("p95_concurrency").cast("long").alias("p95_concurrency"),
    )


def concurrency_peak_sessions(sessions: DataFrame, top: int = 10) -> DataFrame:
    """Sessions open at the first time of the peak, by key."""
    p = _levels(sessions).agg(F.max(F.struct("level", (-F.col("ms")).alias("n")))["n"].alias("n"))
    s = dims.effective_end(sessions.where("started_at is not null")).where("end_ms > start_ms")
    return s.join(F.broadcast(p), (F.col("start_ms") <= -F.col("n")) & (F.col("end_ms") > -F.col("n"))).select("session_key", "source", "kind", "start_ms", "end_ms").orderBy("session_key").limit(top)


def _runs(sessions: DataFrame, **window) -> DataFrame:
    """Maximal runs of sessions of one source, in the order of all sessions."""
    o = _ordered(sessions.where("source is not null and source <> ''"), **window)
    new = F.when(F.col("prev.source") == F.col("source"), 0).otherwise(1)
    o = order.running(o, [], {"run": new})
    return o.groupBy("run", "source").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("a"))


_RUN_QUANTILES = {"p50_run_length": 0.5, "p90_run_length": 0.9, "p99_run_length": 0.99}


def _run_stats():
    """Aggregates over runs; ``stats.percentiles`` has their quantiles."""
    return [
        F.count(F.lit(1)).alias("run_count"), F.sum("n").alias("session_count"), F.avg("n").alias("mean_run_length"),
        F.max("n").alias("max_run_length"), (F.count_if(F.col("n") == 1) / F.sum("n")).alias("single_session_run_share"),
    ]


def source_run_lengths(sessions: DataFrame, min_runs: int = 1, **window) -> DataFrame:
    r = _runs(sessions, **window)
    start = (-F.max(F.struct("n", (-F.col("a")).alias("a")))["a"]).alias("start")
    g = r.groupBy("source").agg(*_run_stats(), start).join(stats.percentiles(r, ["source"], "n", _RUN_QUANTILES), "source")
    return g.where(F.col("run_count") >= min_runs).withColumn("longest_run_started_at", dims.iso_of(F.floor(F.col("start") / 1000)))


def source_run_lengths_global(sessions: DataFrame, **window) -> DataFrame:
    r = _runs(sessions, **window)
    return r.agg(*_run_stats()).crossJoin(stats.percentiles(r, [], "n", _RUN_QUANTILES))


def _snapshots(snapshots: DataFrame, since=None, until=None) -> DataFrame:
    return dims.within(snapshots.where("session_key <> '' and started_at is not null and snapshot_at is not null"), "started_at", since, until)


def idle_gaps(snapshots: DataFrame, min_gap: int = 0, by: str = "all", **window) -> DataFrame:
    """Measured rows (group, x, session_key): seconds between consecutive snapshots of a session.

    The snapshots of all sessions are one order by (session, time), so a long session is many tasks' work.
    """
    columns = list(dict.fromkeys(["session_key", "ms", "started_at", *([] if by == "all" else [by])]))
    s = _snapshots(snapshots, **window).withColumn("ms", dims.epoch_milli("snapshot_at")).select(*columns)
    o = order.numbered(s, "session_key", "ms", "started_at")
    o = o.withColumn("group", F.lit("all")) if by == "all" else order.running(o, ["session_key"], {}, {"group": F.col(by)})
    o = order.neighbour(o, columns=["session_key", "ms"]).where("prev.session_key = session_key")
    x = F.greatest(F.lit(0), (F.col("ms") - F.col("prev.ms")) / 1000)
    return o.withColumn("x", x).where(F.col("x") >= min_gap).select("group", "x", "session_key")


def idle_gap_top_sessions(snapshots: DataFrame, top: int = 10, **opts) -> DataFrame:
    g = idle_gaps(snapshots, **opts).groupBy("session_key").agg(F.count(F.lit(1)).alias("gap_count"), F.max("x").alias("max_gap_seconds"), F.sum("x").alias("total_gap_seconds"))
    return g.orderBy(F.desc("max_gap_seconds"), F.desc("total_gap_seconds"), "session_key").limit(top)


def _hops(snapshots: DataFrame, by: str = "all", **window) -> DataFrame:
    """Snapshots with a model, in one order by (session, time): the model before in the session, and whether it changed."""
    s = _snapshots(snapshots, **window).where("model is not null and model <> ''")
    group = F.lit("all") if by == "all" else F.col(by)
    s = s.select("session_key", "snapshot_at", "started_at", "model", group.alias("group"))
    o = order.with_previous(s, "session_key", "snapshot_at", "started_at", "model")
    o = o.withColumn("before", F.when(F.col("prev.session_key") == F.col("session_key"), F.col("prev.model")))
    return o.withColumn("hop", F.col("before").isNotNull() & (F.col("before") != F.col("model")))


def model_switching(snapshots: DataFrame, min_switches: int = 2, by: str = "all", **window) -> DataFrame:
    """Models of a session's snapshots (raw names): distinct ones, and changes in order."""
    h = _hops(snapshots, by, **window)
    k = h.groupBy("session_key").agg(F.min_by("group", "snapshot_at").alias("group"), F.countDistinct("model").alias("d"), F.count_if(F.col("hop")).alias("t"))
    many = F.col("d") >= min_switches
    return k.groupBy("group").agg(
        F.count(F.lit(1)).alias("considered_sessions"), F.count_if(many).alias("switched_sessions"), (F.count_if(many) / F.count(F.lit(1))).alias("switched_share"), F.coalesce(F.sum(F.when(many, F.col("t"))), F.lit(0)).alias("total_transitions"),
        F.coalesce(F.avg(F.when(many, F.col("d"))), F.lit(0.0)).alias("mean_models_per_switched_session"), stats.nearest("d", 0.5).alias("p50_distinct_models"), stats.nearest("d", 0.9).alias("p90_distinct_models"), stats.nearest("d", 0.99).alias("p99_distinct_models"),
        F.max("d").alias("max_distinct_models"), *[F.count_if(F.col("d") == i if i < 4 else F.col("d") >= 4).alias(f"with_{i}") for i in (1, 2, 3, 4)],
    )


def model_switch_pairs(snapshots: DataFrame, top: int = 10, min_switches: int = 2, **window) -> DataFrame:
    h = _hops(snapshots, **window)
    many = h.groupBy("session_key").agg(F.countDistinct("model").alias("d")).where(F.col("d") >= min_switches).select("session_key")
    g = h.where("hop").join(many, "session_key").groupBy(F.col("before").alias("from"), F.col("model").alias("to")).agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy())).orderBy(F.desc("count"), "from", "to").limit(top)


def runs_retention(runs: DataFrame, keep: int = 100) -> DataFrame:
    """Runs that may go: not among the ``keep`` latest names, nor the last success of their day.

    The latest names are found by a top-k sort (one bounded heap per task).
    """
    latest = runs.select("name").orderBy(F.desc("name")).limit(keep)
    daily = runs.where("status = 'succeeded'").groupBy("day").agg(F.max("name").alias("name")).select("name")
    return runs.join(latest.unionByName(daily).distinct(), "name", "left_anti")
