"""Tenure, cumulative shape, shape of days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, dims, stats
from ..functions.options import equal, options

HOUR = 3600


def tenure(usage: DataFrame, by: str = "model", min_buckets: int = 0, min_models: int = 0, **window) -> DataFrame:
    """First and last bucket, span, density of a model, provider or source."""
    u = cells.active(usage, **window)
    if by == "provider":
        u = u.withColumn("provider", dims.provider(F.col("model")))
    g = u.groupBy(F.col(by).alias("key")).agg(F.min("sec").alias("a"), F.max("sec").alias("b"), F.countDistinct("sec").alias("active_buckets"), F.sum("total").alias("tokens"), F.countDistinct("model").alias("distinct_models"), F.countDistinct("source").alias("distinct_sources"))
    g = g.where((F.col("active_buckets") >= min_buckets) & (F.col("distinct_models") >= min_models))
    span = (F.col("b") - F.col("a")) / HOUR
    return g.withColumns(
        {
            "first_seen": dims.iso_of(F.col("a")), "last_seen": dims.iso_of(F.col("b")), "span_hours": span, "tokens_per_active_bucket": F.col("tokens") / F.col("active_buckets"),
            "tokens_per_span_hour": F.col("tokens") / F.greatest(span, F.lit(1.0)),
        }
    )


def device_tenure(usage: DataFrame, as_of: int, recent_hours: float = 24, **opts) -> DataFrame:
    """``tenure`` of devices with the longest gap between buckets and the time since the last (to second ``as_of``)."""
    t = tenure(usage, "device", **opts)
    b = cells.buckets(usage, "device")
    gap = (F.col("sec") - F.lag("sec").over(Window.partitionBy("device").orderBy("sec"))) / HOUR
    gaps = b.withColumn("gap", gap).groupBy("device").agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("longest_gap_hours"))
    t = t.join(gaps, F.col("key") == F.col("device")).withColumn("hours_since_last_seen", (F.lit(as_of) - F.col("b")) / HOUR)
    return t.withColumn("recently_active", F.col("hours_since_last_seen") < recent_hours)


@options(quadrant=equal("quadrant"))
def tenure_density_quadrant(usage: DataFrame, min_buckets: int = 0, **window) -> DataFrame:
    """Models parted at the median span and density; equals count as long and dense."""
    t = tenure(usage, "model", min_buckets, **window).select(F.col("key").alias("model"), "span_hours", "active_buckets", "tokens", F.col("tokens_per_span_hour").alias("density"))
    m = t.agg(stats.linear("span_hours", 0.5).alias("median_span_hours"), stats.linear("density", 0.5).alias("median_density"))
    name = F.concat_ws("-", F.when(F.col("span_hours") >= F.col("median_span_hours"), "long").otherwise("short"), F.when(F.col("density") >= F.col("median_density"), "dense").otherwise("sparse"))
    return t.crossJoin(F.broadcast(m)).withColumn("quadrant", name)


def source_decay_half_life(usage: DataFrame, min_buckets: int = 0, **window) -> DataFrame:
    """The bucket at which a source has spent half of its tokens."""
    w = Window.partitionBy("source")
    b = cells.buckets(usage, "source", **window)
    b = b.withColumns({"all": F.sum("tokens").over(w), "run": F.sum("tokens").over(w.orderBy("sec").rowsBetween(Window.unboundedPreceding, 0))})
    g = b.groupBy("source").agg(F.min("sec").alias("a"), F.max("sec").alias("b"), F.count(F.lit(1)).alias("active_buckets"), F.sum("tokens").alias("tokens"), F.min(F.when(F.col("run") * 2 >= F.col("all"), F.col("sec"))).alias("h")).where(F.col("active_buckets") >= min_buckets)
    span, half = (F.col("b") - F.col("a")) / HOUR, (F.col("h") - F.col("a")) / HOUR
    part = stats.ratio(half, span)
    return g.withColumns({"first_seen": dims.iso_of(F.col("a")), "last_seen": dims.iso_of(F.col("b")), "span_hours": span, "half_life_iso": dims.iso_of(F.col("h")), "half_life_hours": half, "half_life_fraction": part, "front_load_index": 0.5 - part})


def _midpoints(d: DataFrame) -> DataFrame:
    w = Window.partitionBy("source")
    d = d.withColumns({"all": F.sum("tokens").over(w), "run": F.sum("tokens").over(w.orderBy("dayno").rowsBetween(Window.unboundedPreceding, 0))})
    half = F.min(F.when(F.col("run") * 2 >= F.col("all"), F.col("dayno")))
    g = d.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.min("dayno").alias("a"), F.max("dayno").alias("b"), F.count(F.lit(1)).alias("active_days"), half.alias("m"))
    g = g.withColumns({"tenure_days": F.col("b") - F.col("a") + 1, "midpoint_day_index": F.col("m") - F.col("a")})
    g = g.withColumns({"midpoint_pct_tenure": stats.ratio(F.col("midpoint_day_index"), F.col("tenure_days") - 1), "single_day": F.col("tenure_days") == 1})
    return g.withColumns({"first_active_day": dims.day_of(F.col("a")), "last_active_day": dims.day_of(F.col("b")), "midpoint_day": dims.day_of(F.col("m"))})


def cumulative_tokens_midpoint(usage: DataFrame, min_days: int = 1, low: float = 0.0, high: float = 1.0, **window) -> DataFrame:
    """The day at which a source has spent half of its tokens, as a share of its tenure."""
    g = _midpoints(cells.days(usage, "source", **window))
    return g.where((F.col("active_days") >= min_days) & F.col("midpoint_pct_tenure").between(low, high))


def cumulative_tokens_midpoint_counted(usage: DataFrame, min_days: int = 1, low: float = 0.0, high: float = 1.0, **window) -> DataFrame:
    """``cumulative_tokens_midpoint`` with the counts of rows and sources that were dropped, from the same pass."""
    d, counters = cells.counted(usage, "source", time="dayno", **window)
    x = F.col("midpoint_pct_tenure")
    return cells.floors(_midpoints(d), counters, below_min_days=F.col("active_days") < min_days, below_midpoint_min=x < low, above_midpoint_max=x > high)


def source_debut_recency(usage: DataFrame, fraction: float = 0.25, min_buckets: int = 0, min_share: float = 0.0, **window) -> DataFrame:
    """Days since a source's first and last bucket (to the latest bucket of all), tokens in the first part of its tenure."""
    w = Window.partitionBy("source")
    b = cells.buckets(usage, "source", **window).withColumns({"a": F.min("sec").over(w), "b": F.max("sec").over(w)})
    early = F.col("sec") <= F.col("a") + (F.col("b") - F.col("a")) * fraction
    g = b.groupBy("source").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("active_buckets"), F.sum("tokens").alias("tokens"), F.sum(F.when(early, F.col("tokens")).otherwise(0)).alias("debut_window_tokens"))
    g = g.withColumn("as_of", F.max("b").over(Window.partitionBy()))
    g = g.withColumns(
        {
            "first_seen": dims.iso_of(F.col("a")), "last_seen": dims.iso_of(F.col("b")), "tenure_hours": (F.col("b") - F.col("a")) / HOUR, "days_since_debut": (F.col("as_of") - F.col("a")) / 86400,
            "days_since_last_seen": (F.col("as_of") - F.col("b")) / 86400, "debut_share": stats.ratio("debut_window_tokens", "tokens"),
        }
    )
    return g.where((F.col("active_buckets") >= min_buckets) & (F.col("debut_share") >= min_share))


def newcomer_rollup(usage: DataFrame, newcomer_days: int = 7, **window) -> DataFrame:
    g = source_debut_recency(usage, **window)
    new = F.col("days_since_debut") <= newcomer_days
    s = g.agg(F.max("as_of").alias("z"), F.count_if(new).alias("newcomer_sources"), F.coalesce(F.sum(F.when(new, F.col("tokens"))), F.lit(0)).alias("newcomer_tokens"), F.sum("tokens").alias("t"))
    return s.withColumns({"newcomer_cutoff": dims.iso_of(F.col("z") - newcomer_days * 86400), "newcomer_token_share": stats.ratio("newcomer_tokens", "t")})


def _per_day(usage: DataFrame, **window) -> DataFrame:
    return cells.active(usage, **window).groupBy("day").agg(F.min("sec").alias("a"), F.max("sec").alias("b"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.countDistinct("sec").alias("buckets_on_day"), F.sum("total").alias("tokens_on_day"))


def edge_bucket_of_day(usage: DataFrame, last: bool = False, **window) -> DataFrame:
    """Each day's first (or last) active bucket."""
    d = _per_day(usage, **window)
    return d.select("day", dims.iso_of(F.col("b" if last else "a")).alias("bucket"), F.col("last_hour" if last else "first_hour").alias("hour"), "buckets_on_day", "tokens_on_day")


def _rounded(column: str, q: float):
    return F.floor(stats.linear(column, q) + 0.5)


def edge_bucket_summary(usage: DataFrame, last: bool = False, **window) -> DataFrame:
    """Distribution of that hour over days; of equal modes the lower hour for first buckets, the higher for last ones."""
    d = edge_bucket_of_day(usage, last, **window)
    m = d.groupBy("hour").agg(F.count(F.lit(1)).alias("c")).agg(F.max(F.struct("c", (F.col("hour") if last else -F.col("hour")).alias("h"))).alias("m"))
    s = d.agg(
        F.count(F.lit(1)).alias("distinct_days"), F.sum("tokens_on_day").alias("total_tokens"), F.min("hour").alias("hour_min"), F.max("hour").alias("hour_max"), F.avg("hour").alias("hour_mean"), _rounded("hour", 0.5).alias("hour_median"),
        _rounded("hour", 0.25).alias("hour_p25"), _rounded("hour", 0.75).alias("hour_p75"),
    )
    return s.crossJoin(F.broadcast(m)).withColumns({"hour_mode": F.abs("m.h"), "hour_mode_count": F.col("m.c"), "hour_mode_share": F.col("m.c") / F.col("distinct_days")})


def active_span_per_day(usage: DataFrame, min_span: int = 0, **window) -> DataFrame:
    d = _per_day(usage, **window).withColumn("span_hours", F.col("last_hour") - F.col("first_hour") + 1)
    d = d.withColumn("active_buckets", F.col("buckets_on_day")).withColumn("duty_cycle", F.col("active_buckets") / F.col("span_hours"))
    return d.where(F.col("span_hours") >= min_span)


def active_span_summary(usage: DataFrame, **opts) -> DataFrame:
    """Span percentiles are rounded, those of the duty cycle are not."""
    d = active_span_per_day(usage, **opts)
    return d.agg(
        F.count(F.lit(1)).alias("distinct_days"), F.min("span_hours").alias("span_min"), F.max("span_hours").alias("span_max"), F.avg("span_hours").alias("span_mean"), _rounded("span_hours", 0.5).alias("span_median"), _rounded("span_hours", 0.25).alias("span_p25"),
        _rounded("span_hours", 0.75).alias("span_p75"), F.min("duty_cycle").alias("duty_min"), F.max("duty_cycle").alias("duty_max"), F.avg("duty_cycle").alias("duty_mean"), stats.linear("duty_cycle", 0.5).alias("duty_median"),
        stats.linear("duty_cycle", 0.25).alias("duty_p25"), stats.linear("duty_cycle", 0.75).alias("duty_p75"),
    )


def source_breadth_per_day(usage: DataFrame, min_sources: int = 0, **window) -> DataFrame:
    """Distinct sources of each day; rows without a source go."""
    u = cells.active(usage.where("source is not null and source <> ''"), **window)
    d = u.groupBy("day").agg(F.array_sort(F.collect_set("source")).alias("s"), F.countDistinct("sec").alias("buckets_on_day"), F.sum("total").alias("tokens_on_day"))
    return d.withColumns({"source_count": F.size("s"), "sources": F.array_join("s", ",")}).where(F.col("source_count") >= min_sources)


def source_breadth_summary(usage: DataFrame, **opts) -> DataFrame:
    d = source_breadth_per_day(usage, **opts)
    s = d.agg(
        F.count(F.lit(1)).alias("distinct_days"), F.sum("tokens_on_day").alias("total_tokens"), F.min("source_count").alias("count_min"), F.max("source_count").alias("count_max"), F.avg("source_count").alias("count_mean"), _rounded("source_count", 0.5).alias("count_median"),
        _rounded("source_count", 0.25).alias("count_p25"), _rounded("source_count", 0.75).alias("count_p75"), F.count_if(F.col("source_count") == 1).alias("single_source_days"), F.count_if(F.col("source_count") > 1).alias("multi_source_days"),
    )
    return s.withColumn("multi_source_share", stats.ratio("multi_source_days", "distinct_days"))
