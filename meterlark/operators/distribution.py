"""Percentiles, concentration, histograms, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, dims, stats
from ..functions.options import equal, least, options

# Default edges of the reports.
INTENSITY_EDGES = (1, 1_000, 10_000, 100_000, 1_000_000, 10_000_000)
PROMPT_EDGES = (0, 4_000, 32_000, 128_000, 200_000, 500_000, 1_000_000)
OUTPUT_EDGES = (0, 256, 1_000, 4_000, 8_000, 16_000, 64_000)
LENGTH_EDGES = (60, 300, 900, 1800, 3600, 7200, 14400)
REPLY_EDGES = (0.5, 1, 2, 5, 10, 20)
CADENCE_EDGES = (10, 30, 60, 300, 600, 1800)
VOLUME_EDGES = (2, 5, 10, 20, 50, 100, 200)


def bucket_density_percentile(usage: DataFrame, min_tokens: int = 0, **window) -> DataFrame:
    """Percentiles of the tokens of rows."""
    u = cells.active(usage, **window).where(F.col("total") >= min_tokens)
    names = {"p1": 0.01, "p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    sums = u.agg(F.count(F.lit(1)).alias("total_buckets"), F.sum("total").alias("total_tokens"), F.min("total").alias("min"), F.max("total").alias("max"), F.avg("total").alias("mean"))
    return sums.crossJoin(stats.percentiles(u, [], "total", names))


def _slices(ranks: DataFrame, value: str, bounds: list) -> DataFrame:
    """Rows of each value in each of the given rank slices (number, low, high): value, d, k."""
    cut = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), lo.alias("lo"), hi.alias("hi")) for d, lo, hi in bounds]))
    x = ranks.withColumn("s", cut)
    k = F.least(F.col("before") + F.col("n"), F.col("s.hi")) - F.greatest("before", F.col("s.lo"))
    return x.withColumn("k", k).where("k > 0").select(value, F.col("s.d").alias("d"), "k")


def _ranked(df: DataFrame, value: str) -> DataFrame:
    r = stats.value_ranks(df, value)
    return r.crossJoin(F.broadcast(r.agg(F.sum("n").alias("all_n"), F.sum(F.col("n") * F.col(value)).alias("all_sum"))))


def bucket_density_deciles(usage: DataFrame, min_tokens: int = 0, trim_top_pct: float = 0.0, **window) -> DataFrame:
    """Ten proportional slices of the rows by tokens, after trimming the top share."""
    r = _ranked(cells.active(usage, **window).where(F.col("total") >= min_tokens), "total")
    n = F.col("all_n") - F.floor(F.col("all_n") * trim_top_pct / 100)
    g = _slices(r, "total", [(d, F.floor(n * (d - 1) / 10), F.floor(n * d / 10)) for d in range(1, 11)])
    out = g.groupBy(F.col("d").alias("decile")).agg(F.sum("k").alias("count"), F.sum(F.col("k") * F.col("total")).alias("tokens"), F.min("total").alias("lower_edge"), F.max("total").alias("upper_edge"))
    return out.withColumn("token_share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))


def token_deciles(usage: DataFrame, metric: str = "input", floor: int = 0, **window) -> DataFrame:
    """Ten groups of the rows by a token count; the first ones take what is left over."""
    r = _ranked(cells.rows(usage, **window).where((F.col(metric) > 0) & (F.col(metric) >= floor)), metric)
    base = F.floor(F.col("all_n") / 10)
    more = F.col("all_n") - base * 10
    g = _slices(r, metric, [(d, base * (d - 1) + F.least(F.lit(d - 1), more), base * d + F.least(F.lit(d), more)) for d in range(1, 11)])
    out = g.groupBy(F.col("d").alias("decile")).agg(F.sum("k").alias("bucket_count"), F.sum(F.col("k") * F.col(metric)).alias("tokens_in_decile"), F.min(metric).alias("min_tokens"), F.max(metric).alias("max_tokens"))
    return out.withColumn("share_of_tokens", F.col("tokens_in_decile") / F.sum("tokens_in_decile").over(Window.partitionBy())).withColumn("mean_tokens", F.col("tokens_in_decile") / F.col("bucket_count"))


def token_decile_summary(usage: DataFrame, metric: str = "input", floor: int = 0, **window) -> DataFrame:
    """Gini over rows, shares of the top 10 % and 1 % (rounded up)."""
    r = _ranked(cells.rows(usage, **window).where((F.col(metric) > 0) & (F.col(metric) >= floor)), metric)
    n, x = F.col("n"), F.col(metric)
    ranks = n * F.col("before") + n * (n + 1) / 2  # sum of the ranks of the value's rows

    def top(q: float):
        held = F.greatest(F.lit(0), F.least(n, F.col("before") + n - (F.col("all_n") - F.ceil(F.col("all_n") * q))))
        return F.sum(held * x) / F.first("all_sum")

    s = r.agg(F.first("all_n").alias("bucket_count"), F.first("all_sum").alias("total_tokens"), F.sum(ranks * x).alias("w"), top(0.1).alias("p90_share"), top(0.01).alias("p99_share"))
    gini = F.greatest(F.lit(0.0), 2 * F.col("w") / (F.col("bucket_count") * F.col("total_tokens")) - (F.col("bucket_count") + 1) / F.col("bucket_count"))
    return s.withColumn("gini", gini).drop("w")


def input_token_buckets(usage: DataFrame, top: int = 10, largest: bool = True, metric: str = "input", **window) -> DataFrame:
    """The rows with the most (or fewest) tokens and their share of all."""
    u = cells.rows(usage, **window).where(F.col(metric) > 0)
    total = u.agg(F.sum(metric).alias("_all"))
    order = [F.desc(metric) if largest else F.asc(metric), F.asc("sec"), F.asc("source"), F.asc("model")]
    first = u.select("sec", "source", "model", F.col(metric).alias("tokens")).orderBy(*[o if i else (F.desc("tokens") if largest else F.asc("tokens")) for i, o in enumerate(order)]).limit(top)
    return first.crossJoin(F.broadcast(total)).withColumn("share_of_total", F.col("tokens") / F.col("_all")).withColumn("hour_start", dims.iso_of(F.col("sec")))


def bucket_intensity(usage: DataFrame, min_buckets: int = 0, bucket_tokens_min: int = 0, **window) -> DataFrame:
    b = cells.buckets(usage, "model", **window).where(F.col("tokens") >= bucket_tokens_min)
    n = [F.count_if((F.col("tokens") >= lo) & (F.col("tokens") < hi if hi else F.lit(True))).alias(f"from_{lo}") for lo, hi in zip(INTENSITY_EDGES, [*INTENSITY_EDGES[1:], None], strict=True)]
    g = _percentiles(b, "model", "tokens", n).where(F.col("buckets") >= min_buckets)
    return g.withColumn("spread", stats.ratio("p99", "p50"))


def _percentiles(b: DataFrame, key: str, value: str, more=()) -> DataFrame:
    return b.groupBy(key).agg(
        F.count(F.lit(1)).alias("buckets"), F.sum(value).alias("sum"), F.min(value).alias("min"), stats.nearest(value, 0.5).alias("p50"), stats.nearest(value, 0.9).alias("p90"), stats.nearest(value, 0.99).alias("p99"),
        F.max(value).alias("max"), F.avg(value).alias("mean"), *more,
    )


def token_velocity_percentiles(usage: DataFrame, min_buckets: int = 0, rate_min: float = 0.0, **window) -> DataFrame:
    """Tokens per minute of the hours of each source."""
    b = cells.buckets(usage, "source", **window).withColumn("rate", F.col("tokens") / 60).where(F.col("rate") >= rate_min)
    return _percentiles(b, "source", "rate", [F.sum("tokens").alias("tokens")]).where(F.col("buckets") >= min_buckets)


def cost_per_bucket_percentiles(usage: DataFrame, rates: DataFrame, min_buckets: int = 0, min_cost: float = 0.0, **window) -> DataFrame:
    b = dims.with_cost(cells.rows(usage, **window), rates).groupBy("source", "sec").agg(F.sum("usd").alias("usd")).where((F.col("usd") > 0) & (F.col("usd") >= min_cost))
    return _percentiles(b, "source", "usd").where(F.col("buckets") >= min_buckets)


def bucket_token_gini(usage: DataFrame, min_buckets: int = 1, **window) -> DataFrame:
    b = cells.buckets(usage, "source", **window)
    s = b.groupBy("source").agg(F.count(F.lit(1)).alias("bucket_count"), F.sum("tokens").alias("total_tokens"), F.avg("tokens").alias("mean_tokens"), F.max("tokens").alias("max_bucket_tokens"), F.min("sec").alias("a"), F.max("sec").alias("b"))
    s = s.where(F.col("bucket_count") >= min_buckets).join(stats.gini(b, ["source"], "tokens"), "source")
    return s.withColumns({"top_bucket_share": F.col("max_bucket_tokens") / F.col("total_tokens"), "active_window_start": dims.iso_of(F.col("a")), "active_window_end": dims.iso_of(F.col("b"))})


def bucket_token_gini_summary(usage: DataFrame, **opts) -> DataFrame:
    return bucket_token_gini(usage, **opts).agg(
        F.sum("total_tokens").alias("total_tokens"), F.count(F.lit(1)).alias("observed_sources"), (F.sum(F.col("gini") * F.col("total_tokens")) / F.sum("total_tokens")).alias("weighted_mean_gini"),
        F.avg("gini").alias("unweighted_mean_gini"), F.count_if(F.col("bucket_count") == 1).alias("single_bucket_source_count"),
    )


def daily_token_gini(usage: DataFrame, min_tokens: int = 1000, min_days: int = 2, min_gini: float = 0.0, **window) -> DataFrame:
    d = cells.days(usage, "source", **window)
    s = d.groupBy("source").agg(
        F.sum("tokens").alias("total_tokens"), F.count(F.lit(1)).alias("n_days"), F.min("dayno").alias("a"), F.max("dayno").alias("b"), F.avg("tokens").alias("mean_daily_tokens"), F.max("tokens").alias("max_daily_tokens"),
        F.min(F.struct((-F.col("tokens")).alias("t"), "dayno"))["dayno"].alias("m"),
    ).where((F.col("total_tokens") >= min_tokens) & (F.col("n_days") >= min_days))
    s = s.join(stats.gini(d, ["source"], "tokens"), "source").where(F.col("gini") >= min_gini)
    return s.withColumns({"max_day_share": F.col("max_daily_tokens") / F.col("total_tokens"), "first_day": dims.day_of(F.col("a")), "last_day": dims.day_of(F.col("b")), "max_day": dims.day_of(F.col("m"))})


def tail_share(usage: DataFrame, min_buckets: int = 0, **window) -> DataFrame:
    """Share of the top 1, 5, 10 and 20 % of a source's buckets (counts rounded up), and a coarse concentration."""
    w = Window.partitionBy("source")
    b = cells.buckets(usage, "source", **window)
    b = b.withColumn("i", F.row_number().over(w.orderBy(F.desc("tokens")))).withColumn("n", F.count(F.lit(1)).over(w))

    def held(p: int):
        return F.greatest(F.lit(1), F.ceil(F.col("n") * (p / 100)))

    pcts = (1, 5, 10, 20)
    g = b.groupBy("source").agg(
        F.first("n").alias("bucket_count"), F.sum("tokens").alias("tokens"), *[(F.sum(F.when(F.col("i") <= held(p), F.col("tokens")).otherwise(0)) / F.sum("tokens")).alias(f"top{p}_share") for p in pcts],
        (sum((F.first(held(p)) for p in pcts), F.lit(0)) / (4 * F.first("n"))).alias("base"),
    ).where(F.col("bucket_count") >= min_buckets)
    mean = sum((F.col(f"top{p}_share") for p in pcts), F.lit(0.0)) / 4
    like = (mean - F.col("base")) / F.greatest(1 - F.col("base"), F.lit(1e-9))
    return g.withColumn("gini_like", F.least(F.lit(1.0), F.greatest(F.lit(0.0), like))).drop("base")


def size_bins(usage: DataFrame, metric: str, by: str, edges: tuple[int, ...], **window) -> DataFrame:
    """Rows of each group, and of all (group null), in bins [edge, next edge), empty ones included."""
    u = cells.rows(usage, **window).where(F.col(metric) > 0).withColumn("i", sum((F.when(F.col(metric) >= e, 1).otherwise(0) for e in edges), F.lit(-1)))
    g = u.cube(F.col(by).alias("group"), "i").agg(F.count(F.lit(1)).alias("rows")).where("i is not null")
    names = u.select(F.col(by).alias("_g")).distinct().unionByName(usage.sparkSession.createDataFrame([(None,)], "_g string"))
    bins = usage.sparkSession.createDataFrame([(i, e) for i, e in enumerate(edges)], "_i int, lower long")
    full = names.crossJoin(F.broadcast(bins)).join(g, F.col("_g").eqNullSafe(F.col("group")) & (F.col("_i") == F.col("i")), "left")
    out = full.select(F.col("_g").alias("group"), "lower", F.coalesce("rows", F.lit(0)).alias("rows"))
    return out.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy("group")))


def size_summary(usage: DataFrame, metric: str, by: str, min_rows: int = 0, **window) -> DataFrame:
    """Rows by their ``metric`` tokens; the percentile comes from ranks in chunks of values."""
    u = cells.rows(usage, **window).where(F.col(metric) > 0).select(F.col(by).alias("group"), metric)
    g = u.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.sum(metric).alias("total_tokens"), F.avg(metric).alias("mean_tokens"), F.max(metric).alias("max_tokens"))
    g = g.where(F.col("rows") >= min_rows)
    return g.join(stats.percentiles(u, ["group"], metric, {"p95_tokens": 0.95}), "group")


def burstiness(usage: DataFrame, by: str = "model", min_tokens: int = 0, min_active_hours: int = 1, min_cv: float = 0.0, **window) -> DataFrame:
    b = cells.buckets(usage, by, **window).withColumnRenamed(by, "group")
    g = b.groupBy("group").agg(
        F.sum("tokens").alias("total_tokens"), F.count(F.lit(1)).alias("active_hours"), F.avg("tokens").alias("mean_tokens_per_hour"), F.stddev_pop("tokens").alias("stddev_tokens_per_hour"),
        stats.linear("tokens", 0.5).alias("p50_tokens_per_hour"), stats.linear("tokens", 0.95).alias("p95_tokens_per_hour"), F.max("tokens").alias("max_tokens_per_hour"),
    )
    g = g.withColumn("cv", stats.ratio("stddev_tokens_per_hour", "mean_tokens_per_hour")).withColumn("burst_ratio", stats.ratio("max_tokens_per_hour", "p50_tokens_per_hour"))
    return g.where((F.col("total_tokens") >= min_tokens) & (F.col("active_hours") >= min_active_hours) & (F.col("cv") >= min_cv))


def _windows(b: DataFrame, window_size: int) -> DataFrame:
    """Each ``window_size`` consecutive active buckets of a source, with their variation."""
    w = Window.partitionBy("source").orderBy("sec").rowsBetween(0, window_size - 1)
    r = b.withColumns({"k": F.count(F.lit(1)).over(w), "cv": F.stddev_pop("tokens").over(w) / F.avg("tokens").over(w)})
    return r.where(F.col("k") == window_size)


def _rolling(b: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per source its buckets, per source its windows ``r``)."""
    g = r.groupBy("source").agg(
        F.count(F.lit(1)).alias("window_count"), F.min("cv").alias("min_cv"), stats.nearest("cv", 0.5).alias("p50_cv"), stats.nearest("cv", 0.9).alias("p90_cv"),
        F.max("cv").alias("max_cv"), F.avg("cv").alias("mean_cv"), F.min(F.struct((-F.round("cv", 12)).alias("c"), "sec"))["sec"].alias("p"),
    )
    g = g.withColumn("peak_window_start", dims.iso_of(F.col("p")))
    return b.groupBy("source").agg(F.sum("tokens").alias("total_tokens"), F.count(F.lit(1)).alias("active_buckets"), (F.stddev_pop("tokens") / F.avg("tokens")).alias("global_cv")), g


def rolling_bucket_cv(usage: DataFrame, window_size: int = 12, min_buckets: int = 0, min_window_cv: float = 0.0, **window) -> DataFrame:
    """Variation of each ``window_size`` consecutive active buckets of a source."""
    b = cells.buckets(usage, "source", **window)
    s, g = _rolling(b, _windows(b, window_size).where(F.col("cv") >= min_window_cv))
    return s.where(F.col("active_buckets") >= min_buckets).join(g, "source")


def rolling_bucket_cv_counted(usage: DataFrame, window_size: int = 12, min_buckets: int = 0, min_window_cv: float = 0.0, **window) -> DataFrame:
    """``rolling_bucket_cv`` with what was dropped, from the same pass: rows by reason, sources with fewer buckets than
    a window or the floor, windows below ``min_window_cv``, and sources none of whose windows is left."""
    b, counters = cells.counted(usage, "source", **window)
    r = _windows(b, window_size)
    low = F.col("cv") < min_window_cv
    s, g = _rolling(b, r.where(~low))
    sparse, few = F.col("active_buckets") < window_size, F.col("active_buckets") < min_buckets
    held = s.join(r.groupBy(F.col("source").alias("_s")).agg(F.count_if(low).alias("_low")), F.col("source") == F.col("_s"), "left").drop("_s")
    lows = held.agg(F.coalesce(F.sum(F.when(~(sparse | few), F.col("_low"))), F.lit(0)).alias("dropped_low_cv_windows"))
    full = held.drop("_low").join(g.withColumnRenamed("source", "_s"), F.col("source") == F.col("_s"), "left").drop("_s")
    return cells.floors(full, counters.crossJoin(lows), min_buckets=few, sparse_sources=sparse, all_windows_floored=F.col("window_count").isNull())


def model_mix_entropy(usage: DataFrame, min_tokens: int = 0, **window) -> DataFrame:
    from .cyclic import _entropy_rows

    m = cells.active(usage, **window).groupBy("source", "model").agg(F.sum("total").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))
    return _entropy_rows(m, "source", "model").where(F.col("total_tokens") >= min_tokens)


def _fit(b: DataFrame, *keys: str) -> DataFrame:
    n = F.count(F.lit(1))
    flat = (n < 2) | (F.var_pop("x") == 0) | (F.var_pop("y") == 0)
    slope = F.covar_pop("x", "y") / F.var_pop("x")
    return b.groupBy(*keys).agg(
        n.alias("active_buckets"), F.sum("t").alias("total_tokens"), F.sum("x").alias("total_input_tokens"), F.sum("y").alias("total_output_tokens"), F.avg("x").alias("mean_input"), F.avg("y").alias("mean_output"),
        F.stddev_pop("x").alias("std_input"), F.stddev_pop("y").alias("std_output"), F.when(flat, 0.0).otherwise(F.corr("x", "y")).alias("pearson_r"), F.when(flat, 0.0).otherwise(slope).alias("slope"),
        F.when(flat, 0.0).otherwise(F.avg("y") - slope * F.avg("x")).alias("intercept"), flat.alias("degenerate"),
    )


def _io_points(usage: DataFrame, by: str, include_reasoning: bool, **window) -> DataFrame:
    y = F.col("output") + F.col("reasoning") if include_reasoning else F.col("output")
    return cells.active(usage, **window).groupBy(F.col(by).alias("group"), "sec").agg(F.sum("input").alias("x"), F.sum(y).alias("y"), F.sum("total").alias("t"))


def prompt_output_correlation(usage: DataFrame, by: str = "model", min_buckets: int = 2, min_tokens: int = 0, include_reasoning: bool = False, **window) -> DataFrame:
    return _fit(_io_points(usage, by, include_reasoning, **window), "group").where((F.col("active_buckets") >= min_buckets) & (F.col("total_tokens") >= min_tokens))


def prompt_output_correlation_global(usage: DataFrame, by: str = "model", include_reasoning: bool = False, **window) -> DataFrame:
    """One fit over the points of all groups."""
    return _fit(_io_points(usage, by, include_reasoning, **window))


def source_io_ratio_stability(usage: DataFrame, min_days: int = 3, cv_min: float = 0.0, **window) -> DataFrame:
    d = cells.rows(usage, **window).groupBy("source", "dayno").agg(F.sum("input").alias("i"), F.sum("output").alias("o"), F.sum("total").alias("t"))
    d = d.withColumn("r", F.when(F.col("i") > 0, F.col("o") / F.col("i")))
    g = d.groupBy("source").agg(
        F.sum("t").alias("tokens"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.count(F.lit(1)).alias("active_days"), F.count("r").alias("days_with_ratio"), F.count_if(F.col("i") <= 0).alias("days_with_zero_input"),
        F.coalesce(F.avg("r"), F.lit(0.0)).alias("mean_ratio"), F.coalesce(F.stddev_pop("r"), F.lit(0.0)).alias("std_ratio"),
    )
    g = g.withColumns({"ratio_cv": stats.ratio("std_ratio", "mean_ratio"), "flat_line": (F.col("days_with_ratio") > 0) & (F.col("mean_ratio") == 0), "single_sample": F.col("days_with_ratio") == 1})
    return g.where((F.col("days_with_ratio") >= min_days) & (F.col("ratio_cv") >= cv_min))


def source_benford_digits(usage: DataFrame, min_rows: int = 30, **window) -> DataFrame:
    """First digits of the output tokens of each source against Benford's law, all nine digits."""
    u = cells.rows(usage, **window).where("output > 0")
    g = u.groupBy("source", F.substring(F.col("output").cast("string"), 1, 1).cast("long").alias("d")).agg(F.count(F.lit(1)).alias("c"), F.sum("output").alias("t"))
    w = Window.partitionBy("source")
    totals = g.groupBy("source").agg(F.sum("c").alias("n_rows"), F.sum("t").alias("total_tokens")).where(F.col("n_rows") >= min_rows)
    full = totals.crossJoin(cells.grid(usage, "digit", 1, 9)).join(g.withColumnRenamed("source", "s2"), (F.col("source") == F.col("s2")) & (F.col("digit") == F.col("d")), "left")
    out = full.select("source", "n_rows", "total_tokens", "digit", F.coalesce("c", F.lit(0)).alias("observed"), F.log10(1 + 1 / F.col("digit")).alias("expected_freq"))
    del w
    return out.withColumns({"expected": F.col("expected_freq") * F.col("n_rows"), "observed_freq": F.col("observed") / F.col("n_rows")})


@options(require_mode=equal("mode_digit"))
def source_benford(usage: DataFrame, max_mad: float = 0.0, **opts) -> DataFrame:
    d = source_benford_digits(usage, **opts)
    gap = F.col("observed") - F.col("expected")
    mode = F.max(F.struct("observed", (-F.col("digit")).alias("d")))
    g = d.groupBy("source", "n_rows", "total_tokens").agg(F.sum(gap * gap / F.col("expected")).alias("chi2"), (F.avg(F.abs(F.col("observed_freq") - F.col("expected_freq"))) * 100).alias("mad_percent"), mode.alias("m"))
    g = g.select("source", "n_rows", "total_tokens", "chi2", "mad_percent", (-F.col("m.d")).alias("mode_digit"), (F.col("m.observed") / F.col("n_rows")).alias("mode_freq"))
    return g.where(F.col("mad_percent") <= max_mad) if max_mad else g


def _measured(sessions: DataFrame, value, since=None, until=None, by: str = "all") -> DataFrame:
    s = dims.within(sessions.where("started_at is not null"), "started_at", since, until)
    group = F.lit("all") if by == "all" else dims.or_unknown(by)
    return s.withColumns({"group": group, "x": value})


def session_lengths(sessions: DataFrame, min_seconds: int = 0, **opts) -> DataFrame:
    return _measured(sessions, F.col("duration_seconds").cast("double"), **opts).where((F.col("x") >= 0) & (F.col("x") >= min_seconds))


def reply_ratio(sessions: DataFrame, min_total: int = 2, **opts) -> DataFrame:
    """Assistant over user messages; sessions below ``min_total`` messages or without the user go."""
    kept = sessions.where((F.col("total_messages") >= min_total) & (F.col("user_messages") > 0))
    return _measured(kept, F.col("assistant_messages") / F.col("user_messages"), **opts)


def turn_cadence(sessions: DataFrame, min_seconds: int = 1, min_user: int = 1, **opts) -> DataFrame:
    """Seconds per user message."""
    kept = sessions.where((F.col("duration_seconds") >= min_seconds) & (F.col("user_messages") > 0) & (F.col("user_messages") >= min_user))
    return _measured(kept, F.col("duration_seconds") / F.col("user_messages"), **opts)


def message_volume(sessions: DataFrame, min_total: int = 1, **opts) -> DataFrame:
    return _measured(sessions.where(F.col("total_messages") >= min_total), F.col("total_messages").cast("double"), **opts)


def above_share(measured: DataFrame, threshold: float) -> DataFrame:
    return measured.groupBy("group").agg(F.avg((F.col("x") > threshold).cast("double")).alias("above_threshold_share"))


def session_summary(sessions: DataFrame, by: str = "source", min_seconds: int = 0, since=None, until=None) -> DataFrame:
    s = dims.within(sessions.where("started_at is not null"), "started_at", since, until).where(F.col("duration_seconds") >= min_seconds)
    s = s.withColumn("key", dims.or_unknown(by))
    g = s.groupBy("key").agg(F.count(F.lit(1)).alias("sessions"), F.sum("duration_seconds").alias("total_duration_seconds"), F.sum("total_messages").alias("total_messages"))
    return g.join(stats.percentiles(s, ["key"], "duration_seconds", {}, {"median_duration_seconds": 0.5}), "key")


def session_summary_totals(sessions: DataFrame, min_seconds: int = 0, since=None, until=None) -> DataFrame:
    s = dims.within(sessions.where("started_at is not null"), "started_at", since, until).where(F.col("duration_seconds") >= min_seconds)
    out, names = [F.count(F.lit(1)).alias("total_sessions")], (("duration_seconds", "duration"), ("total_messages", "messages"))
    for c, n in names:
        out += [F.sum(c).alias(f"total_{n}"), F.avg(c).alias(f"mean_{n}"), F.min(c).alias(f"min_{n}"), F.max(c).alias(f"max_{n}")]
        out.append(F.min(F.struct((-F.col(c)).alias("x"), "session_key"))["session_key"].alias(f"most_{n}"))
    totals = s.agg(*out)
    for c, n in names:
        totals = totals.crossJoin(stats.percentiles(s, [], c, {f"p95_{n}": 0.95}, {f"median_{n}": 0.5}))
    return totals


def session_drops(sessions: DataFrame, min_total: int = 2, min_seconds: int = 1, min_user: int = 1, since=None, until=None) -> DataFrame:
    """One row: sessions that the reply and cadence reports drop, by the first reason that holds."""
    s = sessions.where("started_at is null").unionByName(dims.within(sessions.where("started_at is not null"), "started_at", since, until))
    bad, user, total, seconds = F.col("started_at").isNull(), F.coalesce("user_messages", F.lit(0)), F.coalesce("total_messages", F.lit(0)), F.coalesce("duration_seconds", F.lit(-1))
    reply = F.when(bad, "invalid").when(total < min_total, "few").when(user <= 0, "no_user").otherwise("kept")
    cadence = F.when(bad, "invalid").when(seconds < min_seconds, "short").when(user <= 0, "no_user").when(user < min_user, "few_user").otherwise("kept")
    r = s.select(bad.alias("bad"), reply.alias("r"), cadence.alias("c"))

    def n(column: str, value: str):
        return F.count_if(F.col(column) == value)

    return r.agg(
        F.count_if("bad").alias("dropped_invalid_started_at"), n("r", "few").alias("reply_dropped_min_messages"), n("r", "no_user").alias("reply_dropped_zero_user"), n("r", "kept").alias("reply_kept"),
        n("c", "short").alias("cadence_dropped_min_duration"), n("c", "no_user").alias("cadence_dropped_zero_user"), n("c", "few_user").alias("cadence_dropped_min_user"), n("c", "kept").alias("cadence_kept"),
    )
