"""Series of days and hours: trends, forecasts, anomalies, runs, gaps."""

from __future__ import annotations

import calendar
import math
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, dims, stats
from ..functions.options import equal, least, options

HOUR = 3600


def daily_series(usage: DataFrame, end_day: int, days: int, source=None) -> DataFrame:
    """The last ``days`` days with tokens and events, empty days included."""
    u = cells.rows(usage, source=source).where(F.col("dayno").between(end_day - days + 1, end_day))
    g = u.groupBy(F.col("dayno").alias("d")).agg(F.sum("total").alias("t"), F.count(F.lit(1)).alias("e"), F.sum("input").alias("i"), F.sum("cached").alias("c"))
    full = cells.grid(usage, "dayno", end_day - days + 1, end_day).join(g, F.col("dayno") == F.col("d"), "left")
    return full.select("dayno", dims.day_of(F.col("dayno")).alias("day"), *[F.coalesce(a, F.lit(0)).alias(b) for a, b in (("t", "tokens"), ("e", "events"), ("i", "input_tokens"), ("c", "cached_input_tokens"))])


def trend_deltas(usage: DataFrame, as_of: int) -> DataFrame:
    """Last against previous 24 hours and 7 days (to second ``as_of``)."""
    u = cells.rows(usage)

    def total(hours_back: int, hours: int):
        lo, hi = as_of - (hours_back + hours) * HOUR, as_of - hours_back * HOUR
        return F.coalesce(F.sum(F.when((F.col("sec") >= lo) & (F.col("sec") < hi), F.col("total"))), F.lit(0))

    wide = u.agg(*[total(back, n).alias(name) for name, back, n in (("c1", 0, 24), ("p1", 24, 24), ("c7", 0, 168), ("p7", 168, 168))])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("period"), F.col(f"c{k}").alias("current"), F.col(f"p{k}").alias("previous")) for n, k in (("day", 1), ("week", 7))]))
    out = wide.select(rows.alias("r")).select("r.*").withColumn("delta", F.col("current") - F.col("previous"))
    return out.withColumn("pct", F.when(F.col("previous") != 0, F.col("delta") / F.col("previous")))


def trend_by_model(usage: DataFrame, as_of: int, days: int = 14, top: int = 8) -> DataFrame:
    """Second against first half of the window, and tokens per day as text."""
    u = cells.rows(usage).where((F.col("sec") >= as_of - days * 86400) & (F.col("sec") < as_of))
    late = F.col("sec") >= as_of - days * 43200
    g = u.groupBy("model").agg(F.sum(F.when(late, F.col("total")).otherwise(0)).alias("current"), F.sum(F.when(~late, F.col("total")).otherwise(0)).alias("previous"),
                               F.array(*[F.sum(F.when(F.col("dayno") == as_of // 86400 - days + 1 + i, F.col("total")).otherwise(0)) for i in range(days)]).alias("s"))
    g = g.withColumns({"delta": F.col("current") - F.col("previous"), "series": F.array_join(F.transform("s", lambda x: x.cast("string")), ",")})
    return g.withColumn("pct", F.when(F.col("previous") != 0, F.col("delta") / F.col("previous"))).orderBy(F.desc("current"), "model").limit(top)


def forecast_fit(usage: DataFrame, as_of_day: int, lookback: int = 14) -> DataFrame:
    """Least squares over the days of the window (x from 0)."""
    d = daily_series(usage, as_of_day, lookback).select((F.col("dayno") - (as_of_day - lookback + 1)).alias("x"), F.col("tokens").alias("y"))
    g = d.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept("y", "x"), F.avg("y")).alias("intercept"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("sst"),
        F.regr_sxy("y", "x").alias("sxy"), F.sum("y").alias("total"),
    )
    sse = F.greatest(F.lit(0.0), F.col("sst") - F.col("slope") * F.col("sxy"))
    return g.withColumns(
        {"sse": sse, "r2": F.when(F.col("sst") > 0, F.greatest(F.lit(0.0), 1 - sse / F.col("sst"))), "residual_std_err": F.when(F.col("n") >= 3, F.sqrt(sse / (F.col("n") - 2))), "low_confidence": (F.col("n") < 4) | (F.col("total") == 0)}
    )


def forecast_points(usage: DataFrame, as_of_day: int, lookback: int = 14, z: float = 1.96) -> DataFrame:
    """Tomorrow and each later day of the ISO week, with prediction intervals not below 0."""
    sunday = as_of_day + 6 - (as_of_day + 3) % 7
    fit = forecast_fit(usage, as_of_day, lookback)
    ahead = cells.grid(usage, "dayno", as_of_day + 1, max(as_of_day + 1, sunday))
    x = lookback - 1 + F.col("dayno") - as_of_day
    p = ahead.crossJoin(F.broadcast(fit)).withColumn("x", x).withColumn("predicted", F.col("intercept") + F.col("slope") * F.col("x"))
    off = F.col("x") - (lookback - 1) / 2
    half = F.when((F.col("n") < 3) | (F.col("sxx") == 0), F.greatest(F.col("predicted") * 0.5, F.lit(1.0))).otherwise(z * F.col("residual_std_err") * F.sqrt(1 + 1 / F.col("n") + off * off / F.col("sxx")))
    return p.select(dims.day_of(F.col("dayno")).alias("day"), "predicted", F.greatest(F.lit(0.0), F.col("predicted") - half).alias("lower"), (F.col("predicted") + half).alias("upper"), (F.col("dayno") <= sunday).alias("in_week"))


def forecast_week(usage: DataFrame, as_of: int, **opts) -> DataFrame:
    """Tokens of the week so far, and with the forecast of its other days."""
    day = as_of // 86400
    monday = (day - (day + 3) % 7) * 86400
    seen = cells.rows(usage).where(F.col("sec").between(monday, as_of)).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("week_observed"))
    ahead = forecast_points(usage, day, **opts).where("in_week").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("predicted", "lower", "upper")])
    both = seen.crossJoin(ahead)
    return both.select("week_observed", *[(F.col("week_observed") + F.col(c)).alias(n) for c, n in (("predicted", "week_projected"), ("lower", "week_projected_lower"), ("upper", "week_projected_upper"))])


def budget_daily(usage: DataFrame, rates: DataFrame, as_of: int, days: int = 7) -> DataFrame:
    """USD of each of the last days before ``as_of``, empty days included."""
    u = dims.with_cost(cells.rows(usage).where((F.col("sec") >= as_of - days * 86400) & (F.col("sec") < as_of)), rates)
    g = u.groupBy(F.col("dayno").alias("d")).agg(F.sum("usd").alias("u"))
    last = as_of // 86400
    full = cells.grid(usage, "dayno", last - days + 1, last).join(g, F.col("dayno") == F.col("d"), "left")
    return full.select(dims.day_of(F.col("dayno")).alias("day"), F.coalesce("u", F.lit(0.0)).alias("usd"))


def month_of(day: int) -> tuple[int, int]:
    """(first day, length) of the UTC month that holds a day, in days since 1970."""
    at = date(1970, 1, 1) + timedelta(days=day)
    return day - at.day + 1, calendar.monthrange(at.year, at.month)[1]


def budget_status(usage: DataFrame, rates: DataFrame, as_of: int, daily_usd: float, monthly_usd: float | None = None, days: int = 7) -> DataFrame:
    """The month of ``as_of`` (seconds since 1970) and its day against the budget; burn is the window's mean, empty days included."""
    today = as_of // 86400
    month_start_day, month_days = month_of(today)
    month = monthly_usd if monthly_usd is not None else daily_usd * month_days
    u = dims.with_cost(cells.rows(usage).where(F.col("sec") < as_of), rates)

    def spent(low: int):
        return F.coalesce(F.sum(F.when(F.col("sec") >= low, F.col("usd"))), F.lit(0.0))

    s = u.where(F.col("sec") >= min(month_start_day * 86400, as_of - days * 86400)).agg(spent(month_start_day * 86400).alias("month_spend_usd"), spent(today * 86400).alias("today_spend_usd"), (spent(as_of - days * 86400) / days).alias("daily_burn_usd"))
    left = F.lit(month) - F.col("month_spend_usd")
    to_breach = F.ceil(left / F.col("daily_burn_usd"))
    today_of_month = today - month_start_day + 1
    eta = F.when((left > 0) & (F.col("daily_burn_usd") > 0), F.when(to_breach <= month_days - today_of_month, dims.day_of(F.lit(today) + to_breach)))
    ratio = F.col("today_spend_usd") / daily_usd if daily_usd else None
    of_day = F.when(ratio >= 1.5, "breached").when(ratio >= 1, "over").when(ratio >= 0.8, "on-track").otherwise("under") if daily_usd else F.when(F.col("today_spend_usd") > 0, "over").otherwise("under")
    over = (F.col("month_spend_usd") > month) | ((F.col("month_spend_usd") == month) & F.lit(month > 0))
    return s.withColumns(
        {
            "monthly_budget_usd": F.lit(float(month)), "percent_of_month_budget_used": F.col("month_spend_usd") / month if month else F.lit(0.0), "days_remaining_in_month": F.lit(month_days - today_of_month + 1),
            "eta_breach_day": eta, "status": F.when(over, "breached").otherwise(of_day),
        }
    )


def _flag(z, threshold: float):
    return F.when(z >= threshold, "high").when(z <= -threshold, "low").otherwise("normal")


def anomalies(usage: DataFrame, as_of_day: int, lookback: int = 30, baseline: int = 7, threshold: float = 2.0) -> DataFrame:
    """Each day's z against the mean and sample deviation of the days before it."""
    w = Window.orderBy("dayno").rowsBetween(-baseline, -1)
    d = daily_series(usage, as_of_day, lookback + baseline).withColumns({"baseline_mean": F.avg("tokens").over(w), "baseline_std_dev": F.coalesce(F.stddev_samp("tokens").over(w), F.lit(0.0))})
    d = d.where(F.col("dayno") > as_of_day - lookback)
    z = F.when(F.col("baseline_std_dev") > 0, (F.col("tokens") - F.col("baseline_mean")) / F.col("baseline_std_dev"))
    return d.withColumn("z", z).withColumn("status", F.when(F.col("z").isNull(), "flat").otherwise(_flag(F.col("z"), threshold)))


#: Days of one block of the smoothing: powers of 1 - alpha inside a block stay far from 0.
_BLOCK = 64


def smoothed(d: DataFrame, x: str, alpha: float) -> DataFrame:
    """``d`` (a row a day) with ``logit``: x smoothed as alpha x + (1 - alpha) before, over the days that have x;
    other days carry the value on.

    With defined days numbered k = 0, 1, ... the value is q^k x_0 + sum of alpha q^(k - j) x_j over
    j = 1..k, q = 1 - alpha. Inside blocks of days it is a running sum of x_j q^-(j - first) times
    q^(k - first), and what a block hands on is its last value: one row per block.
    """
    day = Window.orderBy("dayno").rowsBetween(Window.unboundedPreceding, 0)
    q = 1.0 - alpha
    block = max(1, min(_BLOCK, int(600 / max(1e-9, -math.log2(max(q, 1e-300))))))
    d = d.withColumn("_k", F.count(x).over(day) - 1).withColumn("_block", F.floor(F.col("_k") / block))
    place = F.col("_k") - F.col("_block") * block
    # x_0 has the weight 1, so that the value starts with it.
    own = F.when(F.col(x).isNotNull(), F.when(F.col("_k") == 0, F.col(x)).otherwise(alpha * F.col(x)) * F.pow(F.lit(q), -place))
    inside = Window.partitionBy("_block").orderBy("dayno").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_sum", F.sum(own).over(inside) * F.pow(F.lit(q), place)).withColumn("_left", F.pow(F.lit(q), place + 1))
    ends = d.where(F.col(x).isNotNull()).groupBy("_block").agg(F.max_by("_sum", "_k").alias("_end"))
    ends = ends.select(F.col("_block").alias("_of"), F.col("_end"))
    # What earlier blocks hand on, each faded by the whole blocks between: a row per block of days.
    before = ends.alias("a").join(ends.alias("b"), F.col("a._of") > F.col("b._of")).select(
        F.col("a._of").alias("_of"), (F.col("b._end") * F.pow(F.lit(q), (F.col("a._of") - F.col("b._of") - 1) * block)).alias("v")
    ).groupBy("_of").agg(F.sum("v").alias("_carry"))
    d = d.join(F.broadcast(before), F.col("_block") == F.col("_of"), "left")
    value = F.col("_sum") + F.col("_left") * F.coalesce("_carry", F.lit(0.0))
    return d.withColumn("logit", F.when(F.col("_k") >= 0, value)).drop("_k", "_block", "_sum", "_left", "_of", "_carry")


def cache_ratio_drift(usage: DataFrame, as_of_day: int, lookback: int = 30, alpha: float = 0.3, baseline: int = 7, threshold: float = 2.0, eps: float = 1e-6) -> DataFrame:
    """Daily cached / (input + cached), smoothed in logit space; days without tokens carry the smoothed value and are not scored."""
    d = daily_series(usage, as_of_day, lookback)
    ratio = F.when(F.col("input_tokens") + F.col("cached_input_tokens") > 0, F.col("cached_input_tokens") / (F.col("input_tokens") + F.col("cached_input_tokens")))
    d = d.withColumn("ratio", ratio)
    clipped = F.least(F.greatest(F.col("ratio"), F.lit(eps)), F.lit(1 - eps))
    d = smoothed(d.withColumn("x", F.when(F.col("ratio").isNotNull(), F.log(clipped / (1 - clipped)))), "x", alpha)
    d = d.withColumn("ewma", 1 / (1 + F.exp(-F.col("logit"))))
    before = Window.orderBy("dayno").rowsBetween(-baseline, -1)
    ready = F.col("ratio").isNotNull() & (F.count("logit").over(before) == baseline)
    d = d.withColumns({"baseline_logit_mean": F.when(ready, F.avg("logit").over(before)), "baseline_logit_std_dev": F.when(ready, F.coalesce(F.stddev_samp("logit").over(before), F.lit(0.0)))})
    z = F.when(F.col("baseline_logit_std_dev") >= 1e-9, (F.col("logit") - F.col("baseline_logit_mean")) / F.col("baseline_logit_std_dev"))
    status = F.when(F.col("ratio").isNull(), "undefined").when(F.col("baseline_logit_std_dev").isNull(), "warmup").when(F.col("z").isNull(), "flat").otherwise(_flag(F.col("z"), threshold))
    return d.withColumn("z", z).withColumn("status", status)


def dashboard_drift(usage: DataFrame, as_of_day: int) -> DataFrame:
    """Last day's tokens against their baseline (percent), last scored ratio against its (points), and whether either alerts."""
    a = anomalies(usage, as_of_day).where(F.col("dayno") == as_of_day).select(F.col("tokens").alias("t"), "baseline_mean", F.col("status").alias("token_status"))
    r = cache_ratio_drift(usage, as_of_day)
    scored = F.col("baseline_logit_mean").isNotNull()
    r = r.withColumn("p", F.row_number().over(Window.orderBy(F.desc(scored), F.desc("dayno")))).where("p = 1").select("ewma", "baseline_logit_mean", F.col("status").alias("ratio_status"))
    both = a.crossJoin(r)
    pct = F.when((F.col("token_status") != "flat") & (F.col("baseline_mean") != 0), (F.col("t") - F.col("baseline_mean")) / F.col("baseline_mean") * 100)
    points = F.when(F.col("ratio_status").isin("high", "low", "normal"), (F.col("ewma") - 1 / (1 + F.exp(-F.col("baseline_logit_mean")))) * 100)
    return both.select("token_status", "ratio_status", pct.alias("token_drift_pct"), points.alias("ratio_drift_pct_points"), ((F.col("token_status") == "high") | F.col("ratio_status").isin("high", "low")).alias("alerting"))


def activity_streaks(usage: DataFrame, as_of_day: int, lookback: int = 30, min_tokens: int = 1) -> DataFrame:
    """Maximal runs of active and idle days."""
    d = daily_series(usage, as_of_day, lookback).withColumn("state", F.when(F.col("tokens") >= min_tokens, "active").otherwise("idle"))
    d = stats.islands(d.withColumn("before", F.lag("state").over(Window.orderBy("dayno"))), [], "dayno", F.col("before") == F.col("state"))
    return d.groupBy("run").agg(F.first("state").alias("state"), F.min("day").alias("start_day"), F.max("day").alias("end_day"), F.count(F.lit(1)).alias("length"), F.sum("tokens").alias("tokens"))


def activity_streak_summary(usage: DataFrame, as_of_day: int, lookback: int = 30, **opts) -> DataFrame:
    r = activity_streaks(usage, as_of_day, lookback, **opts)

    def longest(state: str):
        return F.max(F.when(F.col("state") == state, F.struct("length", (-F.col("run")).alias("r"), "start_day")))

    active = F.when(F.col("state") == "active", F.col("length"))
    s = r.agg(F.coalesce(F.sum(active), F.lit(0)).alias("active_days"), F.count(active).alias("active_run_count"), F.percentile(active, F.lit(0.5)).alias("median_active_length"), F.avg(active).alias("mean_active_length"), longest("active").alias("la"), longest("idle").alias("li"), F.max(F.struct("run", "state", "length")).alias("cur"))
    return s.select(
        "active_days", (F.lit(lookback) - F.col("active_days")).alias("idle_days"), (F.col("active_days") / lookback).alias("active_fraction"), "active_run_count", "median_active_length", "mean_active_length", F.col("la.length").alias("longest_active"),
        F.col("la.start_day").alias("longest_active_start"), F.col("li.length").alias("longest_idle"), F.col("li.start_day").alias("longest_idle_start"), F.col("cur.state").alias("current_state"), F.col("cur.length").alias("current_length"),
    )


def velocity_stretches(usage: DataFrame, as_of: int, hours: int = 168, min_tokens: int = 1) -> DataFrame:
    """Maximal runs of active hours in the window that ends with the hour of ``as_of``."""
    end = as_of // HOUR
    start = end - hours + 1
    u = cells.rows(usage).withColumn("h", F.floor(F.col("sec") / HOUR)).where(F.col("h").between(start, end))
    g = u.groupBy("h").agg(F.sum("total").alias("tokens"), F.sum("input").alias("input_tokens"), F.sum("output").alias("output_tokens"), F.count(F.lit(1)).alias("events")).where((F.col("tokens") >= min_tokens) & (F.col("tokens") > 0))
    r = stats.islands(g, [], "h", F.col("h") == F.col("prev_h") + 1)
    s = r.groupBy("run").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count(F.lit(1)).alias("hours"), *[F.sum(c).alias(c) for c in ("tokens", "input_tokens", "output_tokens", "events")])
    idle = F.col("a") - F.coalesce(F.lag("b").over(Window.orderBy("run")), F.lit(start - 1)) - 1
    return s.withColumns({"start_hour": dims.iso_of(F.col("a") * HOUR), "end_hour": dims.iso_of(F.col("b") * HOUR), "tokens_per_minute": F.col("tokens") / (F.col("hours") * 60), "idle_hours_before": idle})


def velocity_summary(usage: DataFrame, as_of: int, **opts) -> DataFrame:
    s = velocity_stretches(usage, as_of, **opts)
    peak = F.max(F.struct("tokens_per_minute", "hours", (-F.col("a")).alias("n"), "start_hour"))
    longest = F.max(F.struct("hours", "tokens_per_minute", (-F.col("a")).alias("n"), "start_hour"))
    g = s.agg(F.coalesce(F.sum("hours"), F.lit(0)).alias("total_active_hours"), F.count(F.lit(1)).alias("stretch_count"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_active_tokens"), stats.linear("tokens_per_minute", 0.5).alias("median_tokens_per_minute"), peak.alias("p"), longest.alias("l"))
    return g.select("total_active_hours", "stretch_count", "total_active_tokens", stats.ratio(F.col("total_active_tokens"), F.col("total_active_hours") * 60).alias("average_tokens_per_minute"), "median_tokens_per_minute", F.col("p.start_hour").alias("peak_start"), F.col("l.start_hour").alias("longest_start"), F.col("l.hours").alias("longest_hours"))


def _width(b: DataFrame) -> DataFrame:
    """One row: the smallest gap between distinct buckets of all, an hour without one. Buckets are bounded by time."""
    gap = F.col("sec") - F.lag("sec").over(Window.orderBy("sec"))
    return b.select("sec").distinct().select(gap.alias("g")).agg(F.coalesce(F.min("g"), F.lit(HOUR)).alias("width"))


def _streaks(b: DataFrame) -> DataFrame:
    r = stats.islands(b.crossJoin(F.broadcast(_width(b))), ["model"], "sec", F.col("sec") - F.col("prev_sec") == F.col("width"))
    runs = r.groupBy("model", "run").agg(F.count(F.lit(1)).alias("n"), F.min("sec").alias("a"), F.max("sec").alias("b"), F.sum("tokens").alias("t"))
    best = F.max(F.struct("n", (-F.col("run")).alias("r"), "a", "b"))
    g = runs.groupBy("model").agg(
        F.sum("n").alias("active_buckets"), F.count(F.lit(1)).alias("streak_count"), best.alias("x"), F.avg("n").alias("mean_streak_length"), F.sum("t").alias("tokens")
    )
    return g.withColumns({"longest_streak": F.col("x.n"), "longest_streak_start": dims.iso_of(F.col("x.a")), "longest_streak_end": dims.iso_of(F.col("x.b"))})


def bucket_streak_length(usage: DataFrame, min_buckets: int = 0, **window) -> DataFrame:
    """Maximal runs of a model's buckets that follow each other by exactly one bucket width."""
    return _streaks(cells.buckets(usage, "model", **window)).where(F.col("active_buckets") >= min_buckets)


def bucket_streak_length_counted(usage: DataFrame, min_buckets: int = 0, **window) -> DataFrame:
    """``bucket_streak_length`` with the counts of rows and models that were dropped, from the same pass."""
    b, counters = cells.counted(usage, "model", **window)
    return cells.floors(_streaks(b), counters, below_min_buckets=F.col("active_buckets") < min_buckets)


def bucket_gap_distribution(usage: DataFrame, min_gap: int = 0, min_gaps: int = 0, **window) -> DataFrame:
    """Gaps between a source's buckets in bucket widths (at least 1); sources with one bucket have zeros."""
    b = cells.buckets(usage, "source", **window).crossJoin(F.broadcast(_width(cells.buckets(usage, **window))))
    gap = F.floor((F.col("sec") - F.lag("sec").over(Window.partitionBy("source").orderBy("sec"))) / F.col("width") + 0.5)
    b = b.withColumn("g", F.greatest(F.lit(1), gap) + gap * 0).withColumn("g", F.when(F.col("g") >= min_gap, F.col("g")))
    zero = F.lit(0)
    s = b.groupBy("source").agg(
        F.count(F.lit(1)).alias("active_buckets"), F.count("g").alias("gap_count"), F.coalesce(F.min("g"), zero).alias("min_gap"), *[F.coalesce(stats.nearest("g", q), zero).alias(f"p{int(q * 100)}_gap") for q in (0.5, 0.9, 0.99)], F.coalesce(F.max("g"), zero).alias("max_gap"),
        F.coalesce(F.avg("g"), F.lit(0.0)).alias("mean_gap"), F.count_if(F.col("g") == 1).alias("contiguous_gaps"), F.sum("tokens").alias("tokens"),
    )
    return s.where(F.col("gap_count") >= min_gaps).withColumn("contiguous_share", stats.ratio("contiguous_gaps", "gap_count"))


# Edges of the histogram of gaps, in hours.
GAP_EDGES = (1, 2, 3, 6, 12, 24, 48, 168)


def interarrival_time(usage: DataFrame, min_active: int = 0, **window) -> DataFrame:
    """Gaps between a source's buckets in rounded hours, with a histogram."""
    w = Window.partitionBy("source").orderBy("sec")
    b = cells.buckets(usage, "source", **window).withColumn("g", F.floor((F.col("sec") - F.lag("sec").over(w)) / HOUR + 0.5))
    bins = [F.count_if((F.col("g") >= lo) & (F.col("g") < hi if hi else F.lit(True))).alias(f"from_{lo}h") for lo, hi in zip(GAP_EDGES, [*GAP_EDGES[1:], None], strict=True)]
    s = b.groupBy("source").agg(
        F.count(F.lit(1)).alias("active_buckets"), F.count("g").alias("gap_count"), *[F.coalesce(f, F.lit(0)).alias(n) for f, n in ((F.min("g"), "min_hours"), (F.max("g"), "max_hours"), (F.sum("g"), "sum_hours"), (stats.nearest("g", 0.5), "p50_hours"), (stats.nearest("g", 0.9), "p90_hours"))],
        F.coalesce(F.avg("g"), F.lit(0.0)).alias("mean_hours"), *bins,
    )
    return s.where(F.col("active_buckets") >= min_active)


def _day_runs(usage: DataFrame, **window) -> DataFrame:
    d = cells.days(usage, "source", **window)
    r = stats.islands(d, ["source"], "dayno", F.col("dayno") == F.col("prev_dayno") + 1)
    return r.groupBy("source", "run").agg(F.count(F.lit(1)).alias("n"), F.min("dayno").alias("a"), F.max("dayno").alias("b"), F.sum("tokens").alias("t"))


@options(min_longest_streak=least("longest_streak"))
def source_active_day_streak(usage: DataFrame, min_days: int = 1, density_min: float = 0.0, **window) -> DataFrame:
    r = _day_runs(usage, **window)
    best, last = F.max(F.struct("n", (-F.col("run")).alias("r"), "a", "b")), F.max(F.struct("run", "n"))
    g = r.groupBy("source").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("active_days"), F.count(F.lit(1)).alias("streaks"), F.avg("n").alias("mean_streak"), best.alias("x"), last.alias("l"), F.sum("t").alias("tokens"))
    g = g.withColumns(
        {"tenure_days": F.col("b") - F.col("a") + 1, "first_day": dims.day_of(F.col("a")), "last_day": dims.day_of(F.col("b")), "longest_streak": F.col("x.n"), "longest_streak_start": dims.day_of(F.col("x.a")), "longest_streak_end": dims.day_of(F.col("x.b")), "current_streak": F.col("l.n")}
    ).withColumn("density", F.col("active_days") / F.col("tenure_days"))
    return g.where((F.col("active_days") >= min_days) & (F.col("density") >= density_min))


@options(min_longest=least("longest_dry_spell"), min_fraction=least("dry_spell_fraction"))
def source_dry_spell(usage: DataFrame, min_days: int = 1, **window) -> DataFrame:
    """Runs of days without tokens inside a source's tenure; the first of equal longest."""
    w = Window.partitionBy("source").orderBy("dayno")
    d = cells.days(usage, "source", **window).withColumn("gap", F.lead("dayno").over(w) - F.col("dayno") - 1)
    best = F.max(F.when(F.col("gap") > 0, F.struct("gap", (-F.col("dayno")).alias("d"))))
    g = d.groupBy("source").agg(F.min("dayno").alias("a"), F.max("dayno").alias("b"), F.count(F.lit(1)).alias("active_days"), F.count_if(F.col("gap") > 0).alias("n_dry_spells"), F.sum("tokens").alias("tokens"), best.alias("x"))
    g = g.where(F.col("active_days") >= min_days).withColumn("tenure_days", F.col("b") - F.col("a") + 1).withColumn("inactive_days", F.col("tenure_days") - F.col("active_days"))
    start = 1 - F.col("x.d")
    return g.withColumns(
        {"first_day": dims.day_of(F.col("a")), "last_day": dims.day_of(F.col("b")), "longest_dry_spell": F.coalesce("x.gap", F.lit(0)), "longest_dry_spell_start": dims.day_of(start), "longest_dry_spell_end": dims.day_of(start + F.col("x.gap") - 1),
         "mean_dry_spell": stats.ratio("inactive_days", "n_dry_spells"), "dry_spell_fraction": F.col("inactive_days") / F.col("tenure_days")}
    )


@options(min_extreme=least("n_extreme"), direction=equal("max_abs_z_direction"))
def daily_zscore_extremes(usage: DataFrame, min_days: int = 3, sigma: float = 2.0, **window) -> DataFrame:
    """Days of a source further than ``sigma`` population deviations from its mean; the first day of the largest."""
    w = Window.partitionBy("source")
    d = cells.days(usage, "source", **window).withColumns({"m": F.avg("tokens").over(w), "s": F.stddev_pop("tokens").over(w)})
    d = d.withColumn("z", F.when(F.col("s") > 0, (F.col("tokens") - F.col("m")) / F.col("s")).otherwise(0.0))
    top = F.max(F.struct(F.round(F.abs("z"), 12).alias("k"), (-F.col("dayno")).alias("d"), "tokens", "z"))
    g = d.groupBy("source").agg(
        F.sum("tokens").alias("total_tokens"), F.count(F.lit(1)).alias("n_active_days"), F.first("m").alias("mean"), F.first("s").alias("stddev"), F.count_if(F.col("z") > sigma).alias("n_high_extreme"), F.count_if(F.col("z") < -sigma).alias("n_low_extreme"),
        top.alias("x"), F.min("dayno").alias("a"), F.max("dayno").alias("b"),
    ).where(F.col("n_active_days") >= min_days)
    return g.withColumns(
        {
            "flat": F.col("stddev") == 0, "n_extreme": F.col("n_high_extreme") + F.col("n_low_extreme"), "extreme_fraction": (F.col("n_high_extreme") + F.col("n_low_extreme")) / F.col("n_active_days"), "max_abs_z": F.col("x.k"),
            "max_abs_z_day": dims.day_of(-F.col("x.d")), "max_abs_z_tokens": F.col("x.tokens"), "max_abs_z_direction": F.when(F.col("x.z") >= 0, "high").otherwise("low"), "first_active_day": dims.day_of(F.col("a")), "last_active_day": dims.day_of(F.col("b")),
        }
    )


def daily_autocorr_lag1(usage: DataFrame, min_days: int = 3, **window) -> DataFrame:
    """Lag-1 autocorrelation over active days, and over the tenure with empty days as zeros."""
    w = Window.partitionBy("source")
    d = cells.days(usage, "source", **window).withColumns({"n": F.count(F.lit(1)).over(w), "m": F.avg("tokens").over(w), "a": F.min("dayno").over(w), "b": F.max("dayno").over(w), "all": F.sum("tokens").over(w)})
    order = w.orderBy("dayno")
    d = d.withColumns({"next": F.lead("tokens").over(order), "next_day": F.lead("dayno").over(order), "nf": F.col("b") - F.col("a") + 1}).withColumn("mf", F.col("all") / F.col("nf"))
    x, xf = F.col("tokens") - F.col("m"), F.col("tokens") - F.col("mf")
    gap = F.col("next_day") - F.col("dayno") - 1  # empty days between
    # Products of neighbours in the filled series: day with next, or with an empty day at both ends and between empty days.
    pair = F.when(gap == 0, xf * (F.col("next") - F.col("mf"))).when(gap > 0, -F.col("mf") * (xf + (F.col("next") - F.col("mf"))) + (gap - 1) * F.col("mf") * F.col("mf"))
    g = d.groupBy("source").agg(
        F.first("all").alias("total_tokens"), F.first("n").alias("n_active_days"), F.first("nf").alias("n_filled_days"), F.first("m").alias("mean"), F.stddev_pop("tokens").alias("stddev"), F.sum(x * x).alias("va"), F.sum(x * (F.col("next") - F.col("m"))).alias("ca"),
        (F.sum(xf * xf) + (F.first("nf") - F.first("n")) * F.first("mf") * F.first("mf")).alias("vf"), F.sum(pair).alias("cf"), F.first("a").alias("a"), F.first("b").alias("b"),
    ).where(F.col("n_active_days") >= min_days)
    return g.withColumns(
        {
            "rho1_active": stats.ratio("ca", "va"), "flat_active": F.col("va") == 0, "rho1_filled": stats.ratio("cf", "vf"), "flat_filled": F.col("vf") == 0, "first_active_day": dims.day_of(F.col("a")), "last_active_day": dims.day_of(F.col("b")),
        }
    )


def _sign_runs(d: DataFrame, sign: str) -> DataFrame:
    """Runs of equal signs over the numbered days of a source: (source, run, sign, steps, a, b) with first and last day number."""
    d = d.where(F.col(sign).isNotNull()).withColumn("before", F.lag(sign).over(Window.partitionBy("source").orderBy("i")))
    r = stats.islands(d, ["source"], "i", F.col("before") == F.col(sign))
    return r.groupBy("source", "run").agg(F.first(sign).alias("sign"), F.count(F.lit(1)).alias("steps"), F.min("first_day").alias("a"), F.max("last_day").alias("b"))


def _pick(state: str, field: str):
    return F.max(F.when(F.col("sign") == state, F.struct("steps", (-F.col("run")).alias("r"), "a", "b")))[field]


@options(min_longest_run=least("longest_monotone_run"), direction=equal("longest_direction"))
def daily_monotone_runs(usage: DataFrame, min_days: int = 2, **window) -> DataFrame:
    """Longest strictly rising and falling runs of a source's active days, and the current run."""
    order = Window.partitionBy("source").orderBy("dayno")
    d = cells.days(usage, "source", **window).withColumns({"i": F.row_number().over(order), "last_day": F.col("dayno"), "first_day": F.lag("dayno").over(order), "p": F.lag("tokens").over(order)})
    step = F.when(F.col("p").isNotNull(), F.when(F.col("tokens") > F.col("p"), "up").when(F.col("tokens") < F.col("p"), "down").otherwise("flat"))
    r = _sign_runs(d.withColumn("step", step), "step")
    g = r.groupBy("source").agg(*[_pick(s, f).alias(f"{s}_{f}") for s in ("up", "down") for f in ("steps", "a", "b")], F.max(F.struct("run", "sign", "steps")).alias("l"), F.count_if(F.col("sign") != "flat").alias("runs"))
    base = d.groupBy("source").agg(F.sum("tokens").alias("total_tokens"), F.count(F.lit(1)).alias("n_active_days"), F.min("dayno").alias("a"), F.max("dayno").alias("b")).where(F.col("n_active_days") >= min_days)
    g = base.join(g, "source", "left").withColumns({f"longest_{s}_run": F.coalesce(F.col(f"{s}_steps") + 1, F.lit(0)) for s in ("up", "down")})
    longest = F.greatest("longest_up_run", "longest_down_run")
    return g.withColumns(
        {
            **{f"longest_{s}_{n}": dims.day_of(F.col(f"{s}_{c}")) for s in ("up", "down") for n, c in (("start", "a"), ("end", "b"))}, "longest_monotone_run": longest,
            "longest_direction": F.when(longest == 0, "flat").when(F.col("longest_up_run") >= F.col("longest_down_run"), "up").otherwise("down"), "current_direction": F.coalesce("l.sign", F.lit("flat")),
            "current_run_length": F.coalesce(F.col("l.steps") + 1, F.lit(1)), "runs": F.coalesce("runs", F.lit(0)), "first_active_day": dims.day_of(F.col("a")), "last_active_day": dims.day_of(F.col("b")),
        }
    )


@options(min_current_run=least("current_run_length"))
def daily_second_diff_runs(usage: DataFrame, min_days: int = 3, **window) -> DataFrame:
    """Runs of the sign of the second difference of a source's active days; a run covers the days from its first to its last point."""
    order = Window.partitionBy("source").orderBy("dayno")
    d = cells.days(usage, "source", **window).withColumns({"i": F.row_number().over(order), "last_day": F.col("dayno"), "first_day": F.lag("dayno", 2).over(order)})
    second = F.col("tokens") - 2 * F.lag("tokens").over(order) + F.lag("tokens", 2).over(order)
    d = d.withColumn("d2", second).withColumn("regime", F.when(F.col("d2") > 0, "concaveup").when(F.col("d2") < 0, "concavedown").when(F.col("d2") == 0, "flat"))
    names = {"concaveup": "concave_up", "concavedown": "concave_down", "flat": "flat"}
    r = _sign_runs(d, "regime")
    g = r.groupBy("source").agg(
        *[_pick(s, f).alias(f"{n}_{f}") for s, n in names.items() for f in ("steps", "a", "b")], F.max(F.struct("run", "sign", "steps")).alias("l"), F.count(F.lit(1)).alias("total_runs"), F.sum("steps").alias("n_d2_points"),
        *[F.sum(F.when(F.col("sign") == s, F.col("steps")).otherwise(0)).alias(f"n_{n}") for s, n in names.items()],
    )
    base = d.groupBy("source").agg(F.sum("tokens").alias("total_tokens"), F.count(F.lit(1)).alias("n_active_days")).where(F.col("n_active_days") >= min_days)
    g = base.join(g, "source").withColumns({f"longest_{n}_run": F.coalesce(f"{n}_steps", F.lit(0)) for n in names.values()})
    longest = F.greatest(*[f"longest_{n}_run" for n in names.values()])
    regime = F.when(F.col("longest_concave_up_run") == longest, "concaveup").when(F.col("longest_concave_down_run") == longest, "concavedown").otherwise("flat")
    days = {f"longest_{n}_{e}": dims.day_of(F.col(f"{n}_{c}")) for n in names.values() for e, c in (("start", "a"), ("end", "b"))}
    return g.withColumns({**days, "longest_regime_run": longest, "longest_regime": regime, "current_regime": F.col("l.sign"), "current_run_length": F.col("l.steps")})


def _ranks(usage: DataFrame, min_days: int, **window) -> DataFrame:
    w = Window.partitionBy("source")
    d = cells.days(usage, "source", **window).withColumn("k", F.count(F.lit(1)).over(w)).where(F.col("k") >= min_days)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("dayno").orderBy(F.desc("tokens"), "source")))


def source_rank_churn(usage: DataFrame, min_days: int = 1, **window) -> DataFrame:
    """Daily ranks of a source: mean, population deviation, best, worst, number of different ones."""
    return _ranks(usage, min_days, **window).groupBy("source").agg(
        F.count(F.lit(1)).alias("days_observed"), F.avg("rank").alias("mean_rank"), F.stddev_pop("rank").alias("stddev_rank"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), F.countDistinct("rank").alias("distinct_ranks"), F.sum("tokens").alias("total_tokens")
    )


def source_rank_pairs(usage: DataFrame, min_days: int = 1, min_union: int = 2, **window) -> DataFrame:
    """Footrule of the ranks of each pair of following dates; a source absent from one has rank n there."""
    r = _ranks(usage, min_days, **window).select("dayno", "source", "rank")
    dates = r.select(F.col("dayno").alias("day0")).distinct()
    followed = dates.join(dates.select(F.col("day0").alias("day1")), F.col("day1") == F.col("day0") + 1)
    a = followed.join(r.withColumnsRenamed({"rank": "ra"}), F.col("dayno") == F.col("day0")).select("day0", "source", "ra")
    b = followed.join(r.withColumnsRenamed({"rank": "rb"}), F.col("dayno") == F.col("day1")).select("day0", "source", "rb")
    both = a.join(b, ["day0", "source"], "full_outer").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("day0")))
    gap = F.abs(F.coalesce("ra", "n") - F.coalesce("rb", "n"))
    g = both.groupBy("day0").agg(F.first("n").alias("union_size"), F.sum(gap).alias("raw"))
    g = g.where((F.col("union_size") >= min_union) & (F.floor(F.col("union_size") * F.col("union_size") / 2) > 0))
    return g.select(dims.day_of(F.col("day0")).alias("day"), "union_size", (F.col("raw") / F.floor(F.col("union_size") * F.col("union_size") / 2)).alias("footrule"))


def source_rank_summary(usage: DataFrame, **opts) -> DataFrame:
    return source_rank_pairs(usage, **opts).agg(
        F.count(F.lit(1)).alias("day_pairs"), F.count_if(F.col("footrule") == 0).alias("stable_day_pairs"), F.count_if(F.col("footrule") >= 0.5).alias("chaos_day_pairs"), F.avg("footrule").alias("mean_footrule"), stats.nearest("footrule", 0.5).alias("median_footrule"),
        stats.nearest("footrule", 0.9).alias("p90_footrule"), F.max("footrule").alias("max_footrule"),
    )
