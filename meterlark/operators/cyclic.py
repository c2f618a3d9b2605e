"""Profiles over the hours of the day and the days of the week."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, dims, stats
from ..functions.options import least, most, options

_TURN = math.pi / 12


def heatmap_cells(usage: DataFrame, as_of_day: int, lookback: int = 30, metric: str = "total", tz: str | None = None) -> DataFrame:
    """All 168 (dow 1 = Monday, hour) cells of the last ``lookback`` days; ``output`` includes reasoning."""
    kept = cells.rows(usage).where(F.col("dayno").between(as_of_day - lookback + 1, as_of_day))
    if tz:
        local = F.from_utc_timestamp(F.timestamp_seconds("sec"), tz)
        kept = kept.withColumns({"hour": F.hour(local), "dow": F.weekday(local)})
    tokens = F.col("output") + F.col("reasoning") if metric == "output" else F.col(metric)
    g = kept.groupBy((F.col("dow") + 1).alias("d"), F.col("hour").alias("h")).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("events"))
    full = cells.grid(usage, "dow", 1, 7).crossJoin(cells.grid(usage, "hour", 0, 23))
    return full.join(g, (F.col("dow") == F.col("d")) & (F.col("hour") == F.col("h")), "left").select("dow", "hour", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "events")])


def heatmap_summary(usage: DataFrame, as_of_day: int, **opts) -> DataFrame:
    """Peak cell, day and hour (first of equals), best four hours in a row around the clock, best two days."""
    c = heatmap_cells(usage, as_of_day, **opts)
    rows = [F.sum(F.when(F.col("dow") == d, F.col("tokens")).otherwise(0)) for d in range(1, 8)]
    columns = [F.sum(F.when(F.col("hour") == h, F.col("tokens")).otherwise(0)) for h in range(24)]
    peak = F.max(F.struct("tokens", (-(F.col("dow") * 24 + F.col("hour"))).alias("n")))
    s = c.agg(F.array(*rows).alias("r"), F.array(*columns).alias("c"), F.sum("tokens").alias("grand_total"), F.sum("events").alias("events"), peak.alias("p"))
    four = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: sum((F.col("c")[(h + i) % 24] for i in range(1, 4)), F.col("c")[h]))
    two = F.slice(F.sort_array("r", asc=False), 1, 2)
    return s.select(
        "grand_total", "events", F.array_position("r", F.array_max("r")).alias("peak_dow"), (F.array_position("c", F.array_max("c")) - 1).alias("peak_hour"),
        F.col("p.tokens").alias("peak_tokens"), F.floor((-F.col("p.n")) / 24).alias("peak_cell_dow"), (-F.col("p.n") % 24).alias("peak_cell_hour"),
        stats.ratio(F.array_max(four), F.col("grand_total")).alias("diurnal_concentration"), stats.ratio(two[0] + two[1], F.col("grand_total")).alias("weekly_concentration"),
    )


@options(min_cell_tokens=least("tokens"))
def hour_of_week(usage: DataFrame, **window) -> DataFrame:
    """All 168 cells (weekday 1 = Monday): tokens, distinct buckets, share."""
    g = cells.active(usage, **window).groupBy((F.col("dow") + 1).alias("d"), F.col("hour").alias("h")).agg(F.sum("total").alias("tokens"), F.countDistinct("sec").alias("buckets"))
    full = cells.grid(usage, "weekday", 1, 7).crossJoin(cells.grid(usage, "hour", 0, 23))
    out = full.join(g, (F.col("weekday") == F.col("d")) & (F.col("hour") == F.col("h")), "left")
    out = out.select("weekday", "hour", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "buckets")])
    return out.withColumn("token_share", stats.ratio(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())))


def hour_of_week_summary(usage: DataFrame, top_k: int = 10, **window) -> DataFrame:
    """Entropy, its share of log2(168), Gini over all 168 cells, share of the top cells."""
    w = Window.orderBy("tokens", F.desc("weekday"), F.desc("hour"))
    c = hour_of_week(usage, **window).withColumn("i", F.row_number().over(w))
    s = c.agg(
        F.sum("tokens").alias("total_tokens"), F.sum("buckets").alias("total_buckets"), F.count_if(F.col("tokens") > 0).alias("populated_cells"), F.count_if(F.col("tokens") == 0).alias("dead_cells"),
        stats.entropy(F.col("token_share")).alias("entropy_bits"), F.sum(F.col("i") * F.col("tokens").cast("double")).alias("m"),
        F.sum(F.when(F.col("i") > 168 - top_k, F.col("token_share")).otherwise(0.0)).alias("top_k_share"),
    )
    gini = F.when(F.col("total_tokens") > 0, 2 * F.col("m") / (168 * F.col("total_tokens")) - 169 / 168).otherwise(0.0)
    return s.withColumn("normalised_entropy", F.col("entropy_bits") / math.log2(168)).withColumn("gini", F.least(F.lit(1.0), F.greatest(F.lit(0.0), gini))).drop("m")


def _entropy_rows(shares: DataFrame, key: str, part: str) -> DataFrame:
    """Entropy of the tokens of each key over its parts, with the largest part (first by name of equals)."""
    s = shares.withColumn("total_tokens", F.sum("tokens").over(Window.partitionBy(key))).withColumn("share", F.col("tokens") / F.col("total_tokens"))
    g = s.groupBy(key).agg(
        F.first("total_tokens").alias("total_tokens"), F.sum("n_rows").alias("rows"), F.count(F.lit(1)).alias("parts"), stats.entropy(F.col("share")).alias("entropy_bits"),
        F.max("share").alias("top_share"), F.min(F.struct((-F.col("tokens")).alias("t"), F.col(part).alias("p")))["p"].alias("top_part"),
    )
    g = g.withColumn("max_entropy_bits", F.log2(F.col("parts").cast("double")))
    return g.withColumn("normalized_entropy", stats.ratio("entropy_bits", "max_entropy_bits")).withColumn("effective_parts", F.pow(F.lit(2.0), F.col("entropy_bits")))


def hod_source_mix_entropy(usage: DataFrame, min_tokens: int = 0, **window) -> DataFrame:
    """Per hour of the day: entropy over source shares."""
    return _entropy_rows(cells.hours(usage, "source", **window), "hour", "source").where(F.col("total_tokens") >= min_tokens)


def hod_source_mix_summary(usage: DataFrame, **opts) -> DataFrame:
    g = hod_source_mix_entropy(usage, **opts)

    def weighted(c: str) -> Column:
        return stats.ratio(F.sum(F.col(c) * F.col("total_tokens")), F.sum("total_tokens"))

    return g.agg(
        F.sum("total_tokens").alias("total_tokens"), F.count(F.lit(1)).alias("occupied_hours"), weighted("entropy_bits").alias("weighted_mean_entropy_bits"),
        weighted("normalized_entropy").alias("weighted_mean_normalized_entropy"), F.count_if(F.col("parts") == 1).alias("mono_source_hour_count"),
    )


def hod_token_skew(usage: DataFrame, min_days: int = 2, **window) -> DataFrame:
    """Per hour of the day: population skewness of daily totals over the days with rows."""
    d = cells.active(usage, **window).groupBy("hour", "dayno").agg(F.sum("total").alias("t"))
    g = d.groupBy("hour").agg(
        F.count(F.lit(1)).alias("observed_days"), F.sum("t").alias("total_tokens"), F.avg("t").alias("mean_daily_tokens"), F.stddev_pop("t").alias("stddev_daily_tokens"),
        F.skewness("t").alias("s"), F.max("t").alias("max_daily_tokens"), F.min("t").alias("min_daily_tokens"),
    ).where(F.col("observed_days") >= min_days)
    return g.withColumn("skewness", F.when(F.col("stddev_daily_tokens") > 0, F.col("s")).otherwise(0.0)).drop("s")


def time_of_day(sessions: DataFrame, offset_minutes: int = 0, collapse: int = 1, by_source: bool = False, since=None, until=None) -> DataFrame:
    """Sessions by (collapsed) local start hour, empty hours included; with ``by_source`` also those of each source,
    and source is null for all. Shares are those of the source, or of all."""
    s = dims.within(sessions.where("started_at is not null"), "started_at", since, until).withColumn("source", dims.or_unknown("source"))
    local = F.pmod(dims.epoch_second("started_at") + 60 * offset_minutes, F.lit(86400))
    s = s.withColumn("h", F.floor(local / (3600 * collapse)) * collapse)
    hours = cells.grid(sessions, "hour", 0, 23).where(F.col("hour") % collapse == 0)
    if not by_source:
        g = s.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        out = hours.join(g, F.col("hour") == F.col("h"), "left").select("hour", F.coalesce("n", F.lit(0)).alias("sessions"))
        return out.withColumn("share", stats.ratio(F.col("sessions"), F.sum("sessions").over(Window.partitionBy())))
    g = s.groupingSets([["h"], ["h", "source"]], "h", "source").agg(F.count(F.lit(1)).alias("n"))
    names = g.select(F.col("source").alias("of")).distinct()
    met = names.crossJoin(F.broadcast(hours)).join(g, (F.col("hour") == F.col("h")) & F.col("of").eqNullSafe(F.col("source")), "left")
    out = met.select("hour", F.col("of").alias("source"), F.coalesce("n", F.lit(0)).alias("sessions"))
    return out.withColumn("share", stats.ratio(F.col("sessions"), F.sum("sessions").over(Window.partitionBy("source"))))


def peak_hour_share(usage: DataFrame, by: str = "model", min_days: int = 0, min_active_hours: int = 1, peak_hours: int = 1, **window) -> DataFrame:
    """Per group: share of a day's tokens in its largest hours; peak hour of most days (lowest of equals)."""
    g = cells.active(usage, **window).groupBy(F.col(by).alias("group"), "dayno", "hour").agg(F.sum("total").alias("t"))
    i = F.row_number().over(Window.partitionBy("group", "dayno").orderBy(F.desc("t"), "hour"))
    d = g.withColumn("i", i).groupBy("group", "dayno").agg(
        F.sum("t").alias("t"), F.sum(F.when(F.col("i") <= peak_hours, F.col("t"))).alias("p"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("i") == 1, F.col("hour"))).alias("h")
    ).where(F.col("n") >= max(min_active_hours, peak_hours)).withColumn("share", F.col("p") / F.col("t"))
    modes = d.groupBy("group", "h").agg(F.count(F.lit(1)).alias("c")).groupBy("group").agg(F.max(F.struct("c", (-F.col("h")).alias("h"))).alias("m"))
    s = d.groupBy("group").agg(
        F.count(F.lit(1)).alias("days"), F.sum("t").alias("total_tokens"), F.avg("share").alias("mean_peak_share"), stats.nearest("share", 0.5).alias("p50_peak_share"),
        stats.nearest("share", 0.95).alias("p95_peak_share"), F.max("share").alias("max_peak_share"),
    ).where(F.col("days") >= min_days)
    return s.join(modes, "group").select(*s.columns, (-F.col("m.h")).alias("modal_peak_hour"), F.col("m.c").alias("modal_peak_hour_count"))


def _masses(usage: DataFrame, min_tokens: int, **window) -> DataFrame:
    """Per source: totals, buckets, days and the array m of 24 hourly sums."""
    each = [F.sum(F.when(F.col("hour") == h, F.col("total")).otherwise(0)) for h in range(24)]
    g = cells.active(usage, **window).groupBy("source").agg(
        F.sum("total").alias("total_tokens"), F.countDistinct("sec").alias("n_buckets"), F.countDistinct("dayno").alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.array(*each).alias("m")
    ).where(F.col("total_tokens") >= min_tokens)
    flags = F.array_join(F.transform("m", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return g.withColumn("active_hours", F.size(F.filter("m", lambda x: x > 0))).withColumn("flags", flags)


def source_dow_mass_share(usage: DataFrame, min_tokens: int = 1000, min_weekend_share: float = 0.0, **window) -> DataFrame:
    """Seven shares per source (Sunday 0), the largest, the weekend's, entropy over ln 7."""
    u = cells.active(usage, **window).withColumn("d", (F.col("dow") + 1) % 7)
    g = u.groupBy("source").agg(F.sum("total").alias("total_tokens"), F.countDistinct("dayno").alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                                F.array(*[F.sum(F.when(F.col("d") == i, F.col("total")).otherwise(0)) for i in range(7)]).alias("m")).where(F.col("total_tokens") >= min_tokens)
    g = g.withColumn("p", F.transform("m", lambda x: x / F.col("total_tokens")))
    e = F.aggregate("p", F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0)) / math.log(7)
    g = g.withColumns({f"share_{i}": F.col("p")[i] for i in range(7)} | {"dominant_dow": F.array_position("m", F.array_max("m")) - 1, "dominant_share": F.array_max("p"), "weekend_share": F.col("p")[0] + F.col("p")[6], "normalized_entropy": e})
    return g.where(F.col("weekend_share") >= min_weekend_share)


@options(max_spread=most("spread_hours"), min_r=least("resultant_length"))
def source_hour_centroid(usage: DataFrame, min_tokens: int = 1000, **window) -> DataFrame:
    """Circular mean hour, resultant length, circular deviation in hours, peak hour."""
    g = _masses(usage, min_tokens, **window)

    def part(f) -> Column:
        return sum((F.col("m")[h] * f(h * _TURN) for h in range(24)), F.lit(0.0)) / F.col("total_tokens")

    g = g.withColumns({"x": part(math.cos), "y": part(math.sin)})
    r = F.least(F.lit(1.0), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    g = g.withColumn("resultant_length", r)
    spread = F.when(F.col("resultant_length") >= 1, 0.0).when(F.col("resultant_length") <= 0, float("inf")).otherwise(F.sqrt(-2 * F.log("resultant_length")) / _TURN)
    return g.withColumns(
        {"centroid_hour": F.pmod(F.atan2("y", "x") / _TURN, F.lit(24.0)), "spread_hours": spread, "peak_hour": F.array_position("m", F.array_max("m")) - 1, "peak_hour_tokens": F.array_max("m")}
    )


@options(min_share=least("top_k_share"))
def source_hod_topk_share(usage: DataFrame, top_hours: int = 3, min_tokens: int = 1000, min_hours: int = 2, **window) -> DataFrame:
    g = _masses(usage, min_tokens, **window).where(F.col("active_hours") >= min_hours)
    ranked = F.array_sort(F.transform("m", lambda x, i: F.struct((-x).alias("n"), i.alias("h"))))
    first = F.slice(F.filter(ranked, lambda s: s["n"] < 0), 1, top_hours)
    return g.withColumn("n_hours", F.col("active_hours")).withColumn("top_k_share", F.aggregate(first, F.lit(0).cast("long"), lambda a, s: a - s["n"]) / F.col("total_tokens")).withColumn(
        "top_hour_buckets", F.concat_ws(",", F.transform(first, lambda s: s["h"].cast("string")))
    ).withColumn("uniform_baseline", F.lit(top_hours / 24))


def _runs(flags: str, mark: str) -> dict[str, Column]:
    """Longest run of ``mark`` around the clock, number of runs, smallest start of a longest."""
    other = "0" if mark == "1" else "1"
    twice = F.concat(F.col(flags), F.col(flags))
    starts = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: (F.substring(twice, h + 1, F.lit(1)) == mark) & (F.substring(twice, h + 24, F.lit(1)) == other))
    runs = F.transform(starts, lambda h: F.struct((h - (F.instr(F.substring(F.concat(twice, F.lit(other)), h + 1, F.lit(49)), other) - 1) * 100).alias("k"), h.alias("h"), (F.instr(F.substring(twice, h + 1, F.lit(48)), other) - 1).alias("n")))
    all_, none = F.col(flags) == mark * 24, F.col(flags) == other * 24
    best = F.array_min(runs)
    return {
        "longest": F.when(all_, 24).when(none, 0).otherwise(best["n"]), "count": F.when(all_, 1).otherwise(F.size(starts)),
        "start": F.when(all_, 0).when(none, -1).otherwise(best["h"]),
    }


@options(min_dead_hours=least("dead_hours"), min_longest_run=least("longest_dead_run"))
def source_dead_hours(usage: DataFrame, min_tokens: int = 1000, **window) -> DataFrame:
    g, r = _masses(usage, min_tokens, **window), _runs("flags", "0")
    dead = 24 - F.col("active_hours")
    return g.withColumns({"dead_hours": dead, "live_hours": F.col("active_hours"), "dead_share": dead / 24, "longest_dead_run": r["longest"], "dead_run_count": r["count"]})


@options(min_longest_run=least("longest_active_run"), min_active_hours=least("active_hours"))
def source_active_hour_longest_run(usage: DataFrame, min_tokens: int = 1000, **window) -> DataFrame:
    g, r = _masses(usage, min_tokens, **window), _runs("flags", "1")
    return g.withColumns({"longest_active_run": r["longest"], "active_run_count": r["count"], "active_run_share": stats.ratio(r["longest"], F.col("active_hours")), "longest_run_start": r["start"]})


@options(max_span=most("circular_span"), min_largest_quiet_gap=least("largest_quiet_gap"))
def source_active_hour_span(usage: DataFrame, min_tokens: int = 1000, **window) -> DataFrame:
    """Shortest arc of the clock that holds all active hours; of equal quiet gaps the first, the one over midnight last."""
    g = _masses(usage, min_tokens, **window)
    a = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: F.substring("flags", h + 1, F.lit(1)) == "1")
    g = g.withColumn("a", a)
    n = F.col("active_hours")
    gaps = F.transform("a", lambda h, i: F.struct((F.when(i + 1 < n, F.get("a", i + 1)).otherwise(F.col("a")[0] + 24) - h - 1).alias("gap"), (-i).alias("i"), F.when(i + 1 < n, F.get("a", i + 1)).otherwise(F.col("a")[0]).alias("next")))
    g = g.withColumn("g", F.array_max(gaps))
    gap = F.col("g.gap")
    start = F.when(n == 24, 0).otherwise(F.col("g.next"))
    return g.withColumns(
        {"circular_span": 24 - gap, "span_start_hour": start, "span_end_hour": (start + 23 - gap) % 24, "largest_quiet_gap": gap, "span_density": n / (24 - gap)}
    )


@options(min_normalized=least("entropy_normalized"), min_effective_hours=least("effective_hours"))
def source_hod_entropy(usage: DataFrame, min_tokens: int = 1000, **window) -> DataFrame:
    g = _masses(usage, min_tokens, **window)
    p = F.transform("m", lambda x: x / F.col("total_tokens"))
    e = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(0.0))
    g = g.withColumn("entropy_bits", e)
    two = F.pow(F.lit(2.0), F.col("entropy_bits"))
    return g.withColumns(
        {"entropy_normalized": F.col("entropy_bits") / math.log2(24), "effective_hours": two, "concentration_gap": F.col("active_hours") - two, "top_hour_share": F.array_max("m") / F.col("total_tokens"), "top_hour": F.array_position("m", F.array_max("m")) - 1}
    )
