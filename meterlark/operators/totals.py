"""Totals, pivots, cost, projects, mixes and ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, dims, stats, storage

SUMS = {"total_tokens": "total", "input_tokens": "input", "output_tokens": "output", "reasoning_tokens": "reasoning", "cached_input_tokens": "cached"}


def _sums():
    return [F.sum(v).alias(k) for k, v in SUMS.items()] + [F.count(F.lit(1)).alias("events")]


def digest(usage: DataFrame, **window) -> DataFrame:
    """Six sums by day, source, model, hour of the day and in all: (dimension, key, ...). Rows
    without tokens count as events. One aggregation over grouping sets."""
    u = cells.rows(usage, **window).select("day", "source", "model", F.lpad(F.col("hour").cast("string"), 2, "0").alias("hod"), *SUMS.values())
    by = u.groupingSets([["day"], ["source"], ["model"], ["hod"], []], "day", "source", "model", "hod").agg(*_sums(), F.grouping_id().alias("g"))
    # Bits of grouping_id from the left: day, source, model, hod; 0 where the column is grouped by.
    kind = F.when(F.col("g") == 7, "day").when(F.col("g") == 11, "source").when(F.col("g") == 13, "model").when(F.col("g") == 14, "hour").otherwise("total")
    return by.select(kind.alias("dimension"), F.coalesce("day", "source", "model", "hod", F.lit("all")).alias("key"), *SUMS, "events")


def digest_by(usage: DataFrame, dimension: str, **window) -> DataFrame:
    """The rows of ``digest`` of one dimension (day, source, model, hour, total), without the others' work."""
    hod = F.lpad(F.col("hour").cast("string"), 2, "0")
    keys = {"day": F.col("day"), "source": F.col("source"), "model": F.col("model"), "hour": hod, "total": F.lit("all")}
    return cells.rows(usage, **window).groupBy(keys[dimension].alias("key")).agg(*_sums())


def top_pairs(usage: DataFrame, top: int = 15, **window) -> DataFrame:
    return cells.rows(usage, **window).groupBy("source", "model").agg(F.sum("total").alias("tokens"), F.count(F.lit(1)).alias("events")).orderBy(F.desc("tokens"), "source", "model").limit(top)


def digest_projects(sessions: DataFrame, top: int = 10, since=None, until=None) -> DataFrame:
    s = dims.within(sessions, "last_message_at", since, until).where("project_ref is not null and project_ref <> ''")
    return s.groupBy("project_ref").agg(F.count(F.lit(1)).alias("sessions"), F.sum("total_messages").alias("messages")).orderBy(F.desc("messages"), "project_ref").limit(top)


def sources_pivot(usage: DataFrame, **window) -> DataFrame:
    """Tokens by source and model in long form, with both totals."""
    t = cells.rows(usage, **window).groupBy("source", "model").agg(F.sum("total").alias("tokens"))
    return t.withColumn("source_tokens", F.sum("tokens").over(Window.partitionBy("source"))).withColumn("model_tokens", F.sum("tokens").over(Window.partitionBy("model")))


def sources_matrix(usage: DataFrame, models: list[str], **window) -> DataFrame:
    """The same with a column for each of the given models."""
    return cells.rows(usage, **window).groupBy("source").pivot("model", models).agg(F.sum("total"))


def _costs(usage: DataFrame, rates: DataFrame, **window) -> DataFrame:
    """Sums by model with their costs, which are linear in tokens: a row per model is priced, not a row of the log."""
    return dims.with_cost(cells.by_model(usage, **window), rates)


def cost_by_model(usage: DataFrame, rates: DataFrame, **window) -> DataFrame:
    costs = ("input_cost", "cached_cost", "output_cost", "reasoning_cost")
    g = _costs(usage, rates, **window).where("rate_model is not null").withColumn("reasoning_tokens", F.col("reasoning_output_tokens"))
    g = g.withColumn("total_cost", sum((F.col(x) for x in costs), F.lit(0.0)))
    billable = F.col("input_tokens") + F.col("cached_input_tokens") + F.col("output_tokens") + F.col("reasoning_tokens")
    return g.withColumn("blended_rate_per_million", stats.ratio(F.col("total_cost") * 1e6, billable))


def cost_summary(usage: DataFrame, rates: DataFrame, **window) -> DataFrame:
    c = _costs(usage, rates, **window)
    at_input = F.coalesce(F.col("cached_input_tokens") * F.col("r_input") / 1e6, F.lit(0.0))
    s = c.agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("total_cost"), F.coalesce(F.sum(F.col("usd") - F.col("cached_cost") + at_input), F.lit(0.0)).alias("total_cost_no_cache"))
    return s.withColumn("cache_savings", F.greatest(F.lit(0.0), F.col("total_cost_no_cache") - F.col("total_cost")))


def cost_unknown_models(usage: DataFrame, rates: DataFrame, **window) -> DataFrame:
    u = cells.by_model(usage, **window)
    left = u.join(storage.if_small(rates), u["model"] == rates["rate_model"], "left_anti")
    return left.select("model", "events", F.col("total").alias("total_tokens"))


def _attributed(usage: DataFrame, sessions: DataFrame, since=None, until=None) -> tuple[DataFrame, DataFrame]:
    s = dims.within(sessions, "last_message_at", since, until).where("project_ref is not null and project_ref <> ''")
    s = s.select("source", "project_ref", dims.epoch_day("last_message_at").alias("dayno"), F.greatest(F.lit(1), F.coalesce("total_messages", F.lit(0))).alias("m"))
    w = s.groupBy("source", "dayno", "project_ref").agg(F.sum("m").alias("w"))
    w = w.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("source", "dayno")))
    tokens = cells.rows(usage, since=since, until=until).groupBy(F.col("raw_source").alias("source"), "dayno").agg(F.sum("total").alias("tokens"))
    return tokens, w


def project_attribution(usage: DataFrame, sessions: DataFrame, **window) -> DataFrame:
    """Tokens of each (source, day) dealt to projects by their share of messages; by project and
    source, and by project in all (source null), each rounded for itself."""
    tokens, w = _attributed(usage, sessions, **window)
    shares = tokens.join(w, ["source", "dayno"]).withColumn("tokens", F.col("share") * F.col("tokens"))
    return shares.rollup("project_ref", "source").agg(F.floor(F.sum("tokens") + 0.5).alias("tokens")).where("project_ref is not null")


def project_unattributed(usage: DataFrame, sessions: DataFrame, **window) -> DataFrame:
    tokens, w = _attributed(usage, sessions, **window)
    return tokens.join(w, ["source", "dayno"], "left_anti").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("unattributed_tokens"))


def top_projects(usage: DataFrame, sessions: DataFrame, lookup: DataFrame, top: int = 10, **window) -> DataFrame:
    p = project_attribution(usage, sessions, **window).where("source is null").select("project_ref", F.col("tokens").alias("total_tokens"))
    total = p.agg(F.sum("total_tokens").alias("_all"))
    first = p.orderBy(F.desc("total_tokens"), "project_ref").limit(top)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total_tokens"), "project_ref")))
    named = ranked.join(lookup, "project_ref", "left").crossJoin(F.broadcast(total))
    return named.withColumn("share", stats.ratio("total_tokens", "_all")).drop("_all")


def agent_mix(usage: DataFrame, by: str = "source", metric: str = "total", **window) -> DataFrame:
    """Tokens, events, active hours and share of each group, largest first (rank)."""
    u = cells.rows(usage, **window).where(F.col(metric) >= 0).withColumn("group", F.coalesce(F.col("raw_model"), F.lit("unknown")) if by == "model" else F.col("source"))
    g = u.groupBy("group").agg(F.sum(metric).alias("tokens"), F.count(F.lit(1)).alias("events"), F.countDistinct("sec").alias("active_hours"))
    everything = Window.orderBy(F.desc("tokens"), "group")
    return g.withColumn("rank", F.row_number().over(everything)).withColumn("share", stats.ratio(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())))


def agent_mix_summary(usage: DataFrame, **opts) -> DataFrame:
    g = agent_mix(usage, **opts).where("tokens > 0")
    n = g.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    up = Window.orderBy("tokens", F.desc("group")).rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn("cum", F.sum("share").over(up))
    return n.agg(
        F.sum("tokens").alias("total_tokens"), F.max("n").alias("group_count"), F.sum(F.col("share") * F.col("share")).alias("hhi"),
        F.when(F.max("n") >= 2, F.greatest(F.lit(0.0), 1 - F.sum(2 * F.col("cum") - F.col("share")) / F.max("n"))).otherwise(0.0).alias("gini"),
        F.sum(F.when(F.col("rank") <= F.ceil(F.col("n") / 2), F.col("share")).otherwise(0.0)).alias("top_half_share"),
    )


def device_share(usage: DataFrame, min_tokens: int = 0, redact: bool = False, **window) -> DataFrame:
    parts = {"input_tokens": "input", "cached_input_tokens": "cached", "output_tokens": "output", "reasoning_output_tokens": "reasoning"}
    u = cells.active(usage.where(F.trim("device_id") != "").withColumn("device_id", F.trim("device_id")), **window)
    g = u.groupBy("device").agg(
        F.sum("total").alias("total_tokens"), *[F.sum(F.greatest(F.col(v), F.lit(0))).alias(k) for k, v in parts.items()],
        F.count(F.lit(1)).alias("rows"), F.countDistinct("sec").alias("active_hours"), F.countDistinct("model").alias("distinct_models"),
        F.countDistinct("source").alias("distinct_sources"), F.min("sec").alias("a"), F.max("sec").alias("b"),
    ).where(F.col("total_tokens") >= min_tokens)
    # Devices may be many: their total is a row of its own, not a window over them.
    g = g.crossJoin(F.broadcast(g.agg(F.sum("total_tokens").alias("_all"))))
    name = F.concat(F.lit("dev-"), F.substring(F.sha2("device", 256), 1, 8)) if redact else F.col("device")
    return g.withColumns(
        {
            "device_id": name, "share": stats.ratio("total_tokens", "_all"),
            "cache_hit_ratio": stats.ratio("cached_input_tokens", "input_tokens"), "first_seen": dims.iso_of(F.col("a")), "last_seen": dims.iso_of(F.col("b")),
        }
    ).drop("device", "a", "b", "_all")


def cache_hit_ratio(usage: DataFrame, min_rows: int = 0, **window) -> DataFrame:
    """Cached over input by model and source, and by model (source null); not clamped."""
    u = cells.rows(usage, **window).where("input > 0 and cached >= 0")
    g = u.rollup("model", "source").agg(F.count(F.lit(1)).alias("rows"), F.sum("input").alias("input_tokens"), F.sum("cached").alias("cached_input_tokens"))
    return g.where((F.col("model").isNotNull()) & (F.col("rows") >= min_rows)).withColumn("hit_ratio", stats.ratio("cached_input_tokens", "input_tokens"))


def cache_hit_by_hour(usage: DataFrame, **window) -> DataFrame:
    """Cached (at most the input of its row) over input by source and hour, and by hour (source null); 24 hours each."""
    u = cells.rows(usage, **window).where("input > 0")
    clamped = F.greatest(F.lit(0), F.least("cached", "input"))
    g = u.cube("source", "hour").agg(F.sum("input").alias("input_tokens"), F.sum(clamped).alias("cached_input_tokens"), F.count(F.lit(1)).alias("rows")).where("hour is not null")
    names = u.select("source").distinct().unionByName(usage.sparkSession.createDataFrame([(None,)], "source string"))
    full = names.crossJoin(F.broadcast(cells.grid(usage, "hour", 0, 23)))
    both = full.join(g.withColumnsRenamed({"source": "s2", "hour": "h2"}), F.col("source").eqNullSafe(F.col("s2")) & (F.col("hour") == F.col("h2")), "left")
    out = both.select("source", "hour", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("input_tokens", "cached_input_tokens", "rows")])
    return out.withColumn("cache_ratio", stats.ratio("cached_input_tokens", "input_tokens"))


def cache_hit_extremes(usage: DataFrame, **window) -> DataFrame:
    """Each source's ratio, its best and worst hour among hours with input, and their distance."""
    h = cache_hit_by_hour(usage, **window).where("source is not null and input_tokens > 0")
    best, worst = F.struct("cache_ratio", (-F.col("hour")).alias("h")), F.struct("cache_ratio", F.col("hour").alias("h"))
    g = h.groupBy("source").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("cached_input_tokens").alias("cached_input_tokens"), F.max(best).alias("p"), F.min(worst).alias("t"))
    return g.select(
        "source", "input_tokens", "cached_input_tokens", stats.ratio("cached_input_tokens", "input_tokens").alias("cache_ratio"),
        (-F.col("p.h")).alias("peak_hour"), F.col("p.cache_ratio").alias("peak_ratio"), F.col("t.h").alias("trough_hour"), F.col("t.cache_ratio").alias("trough_ratio"),
        (F.col("p.cache_ratio") - F.col("t.cache_ratio")).alias("spread"),
    )


def reasoning_share(usage: DataFrame, min_rows: int = 0, **window) -> DataFrame:
    u = cells.rows(usage, **window).where("output + reasoning > 0")
    g = u.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.sum("output").alias("output_tokens"), F.sum("reasoning").alias("reasoning_tokens")).where(F.col("rows") >= min_rows)
    g = g.withColumn("generated_tokens", F.col("output_tokens") + F.col("reasoning_tokens"))
    return g.withColumn("reasoning_share", stats.ratio("reasoning_tokens", "generated_tokens"))


def _models(u: DataFrame, by_source: bool, *aggregates) -> DataFrame:
    """Aggregates by model; ``by_source`` adds those of each (model, source) from the same pass, and source is null for the model's own."""
    if not by_source:
        return u.groupBy("model").agg(*aggregates)
    return u.groupingSets([["model"], ["model", "source"]], "model", "source").agg(*aggregates)


def _of_kept(g: DataFrame, by_source: bool, kept) -> DataFrame:
    """Rows of the models that pass a floor; a model's sources stay or go with it."""
    if not by_source:
        return g.where(kept)
    models = g.where(F.col("source").isNull() & kept).select("model")
    return g.join(models, "model", "left_semi")


def output_input_ratio(usage: DataFrame, min_rows: int = 0, by_source: bool = False, **window) -> DataFrame:
    """Output over input tokens of each model, as sums and as the mean of its rows; with ``by_source`` also of its sources."""
    u = cells.rows(usage, **window).where("input > 0 and output >= 0")
    g = _models(
        u, by_source, F.count(F.lit(1)).alias("rows"), F.sum("input").alias("input_tokens"), F.sum("output").alias("output_tokens"),
        F.avg(F.col("output") / F.col("input")).alias("mean_row_ratio"),
    )
    return _of_kept(g, by_source, F.col("rows") >= min_rows).withColumn("ratio", stats.ratio("output_tokens", "input_tokens"))


def weekday_share(usage: DataFrame, by: str = "model", min_tokens: int = 0, min_active: int = 1, **window) -> DataFrame:
    """Seven sums (Monday 0) of each group and of all (group null), peak day, active days, HHI."""
    u = cells.active(usage, **window).withColumn("group", F.col(by))
    names = [f"tokens_{d}" for d in range(7)]
    g = u.rollup("group").agg(F.sum("total").alias("total_tokens"), *[F.sum(F.when(F.col("dow") == d, F.col("total")).otherwise(0)).alias(n) for d, n in enumerate(names)])
    each = F.array(*names)
    g = g.withColumns(
        {
            "peak_weekday": F.array_position(each, F.array_max(each)) - 1, "peak_share": stats.ratio(F.array_max(each), F.col("total_tokens")),
            "active_weekdays": F.size(F.filter(each, lambda x: x > 0)),
            "hhi": F.aggregate(each, F.lit(0.0), lambda a, x: a + F.pow(x / F.col("total_tokens"), F.lit(2))),
        }
    )
    return g.where(F.col("group").isNull() | ((F.col("total_tokens") >= min_tokens) & (F.col("active_weekdays") >= min_active)))


def weekend_vs_weekday(usage: DataFrame, min_rows: int = 0, by_source: bool = False, **window) -> DataFrame:
    """Saturday and Sunday against the other days, of each model; with ``by_source`` also of its sources."""
    weekend = F.col("dow") >= 5
    # Kept apart from the grouping column, which is null in the rows of whole models.
    u = cells.active(usage, **window).withColumn("_source", F.col("source"))
    g = _models(
        u, by_source, F.sum(F.when(weekend, F.col("total")).otherwise(0)).alias("weekend_tokens"), F.sum(F.when(~weekend, F.col("total")).otherwise(0)).alias("weekday_tokens"),
        F.sum("total").alias("total_tokens"), F.count_if(weekend).alias("weekend_rows"), F.count_if(~weekend).alias("weekday_rows"),
        F.countDistinct("_source").alias("distinct_sources"), F.min("sec").alias("a"), F.max("sec").alias("b"),
    )
    g = _of_kept(g, by_source, F.col("weekend_rows") + F.col("weekday_rows") >= min_rows)
    both = F.when(F.col("weekday_tokens") > 0, F.col("weekend_tokens") / F.col("weekday_tokens")).when(F.col("weekend_tokens") > 0, F.lit(float("inf"))).otherwise(0.0)
    return g.withColumns(
        {
            "weekend_share": stats.ratio("weekend_tokens", "total_tokens"), "weekday_share": stats.ratio("weekday_tokens", "total_tokens"),
            "weekend_to_weekday_ratio": both, "first_seen": dims.iso_of(F.col("a")), "last_seen": dims.iso_of(F.col("b")),
        }
    ).drop("a", "b")


def preset(name: str, as_of_day: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """Days (from, until) of two windows: dod, wow (calendar weeks so far) or rolling-week."""
    tomorrow = as_of_day + 1
    if name == "dod":
        return (as_of_day, tomorrow), (as_of_day - 1, as_of_day)
    if name == "rolling-week":
        return (tomorrow - 7, tomorrow), (tomorrow - 14, tomorrow - 7)
    monday = as_of_day - (as_of_day + 3) % 7
    return (monday, tomorrow), (monday - 7, tomorrow - 7)


def compare_windows(usage: DataFrame, a: tuple[int, int], b: tuple[int, int], by: str = "source", min_tokens: int = 0) -> DataFrame:
    """Tokens and events of each key in two ranges of days, with Welch's t over daily totals, empty days included."""
    u = cells.rows(usage).withColumn("key", F.col(by))
    sides = {s: (F.col("dayno") >= lo) & (F.col("dayno") < hi) for s, (lo, hi) in (("a", a), ("b", b))}
    size = {"a": a[1] - a[0], "b": b[1] - b[0]}
    d = u.where(sides["a"] | sides["b"]).groupBy("key", "dayno").agg(F.sum("total").alias("t"), F.count(F.lit(1)).alias("e"))
    sums = []
    for s, inside in sides.items():
        t = F.when(inside, F.col("t")).otherwise(0)
        sums += [F.sum(t).alias(f"{s}_tokens"), F.sum(F.when(inside, F.col("e")).otherwise(0)).alias(f"{s}_events"), F.sum(t.cast("double") * t).alias(f"{s}2")]
    g = d.groupBy("key").agg(*sums).where(F.col("a_tokens") + F.col("b_tokens") >= min_tokens)
    mean = {s: F.col(f"{s}_tokens") / size[s] for s in sides}
    # Days without rows are zeros: they count in the size only.
    var = {s: F.greatest(F.lit(0.0), (F.col(f"{s}2") - size[s] * mean[s] * mean[s]) / max(1, size[s] - 1)) for s in sides}
    root = F.sqrt(var["a"] / size["a"] + var["b"] / size["b"])
    t = F.when(root == 0, F.when(mean["a"] == mean["b"], 0.0).when(mean["a"] > mean["b"], float("inf")).otherwise(float("-inf"))).otherwise((mean["a"] - mean["b"]) / root)
    t = t if min(size.values()) >= 2 else F.lit(None).cast("double")
    hint = F.when(F.col("t").isNull(), "insufficient").when(F.abs("t") >= 1.96, "significant").when(F.abs("t") >= 1.28, "weak").otherwise("n/s")
    g = g.withColumn("delta", F.col("a_tokens") - F.col("b_tokens")).withColumn("pct", F.when(F.col("b_tokens") != 0, F.col("delta") / F.col("b_tokens")))
    return g.withColumn("t", t).withColumn("hint", hint).drop("a2", "b2")


def _session_rows(sessions: DataFrame, since=None, until=None) -> DataFrame:
    return dims.within(sessions.where("started_at is not null"), "started_at", since, until)


def provider_share(sessions: DataFrame, top_models: int = 3, min_sessions: int = 0, **window) -> DataFrame:
    s = _session_rows(sessions, **window).where("total_messages >= 0").withColumn("model", dims.normalise_model("model"))
    m = s.withColumn("provider", dims.provider(F.col("model"))).groupBy("provider", "model").agg(F.count(F.lit(1)).alias("n"), F.sum("total_messages").alias("m"))
    m = m.withColumn("i", F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("n"), "model")))
    named = F.concat_ws(":", "model", F.col("n").cast("string"))
    g = m.groupBy("provider").agg(
        F.sum("n").alias("sessions"), F.sum("m").alias("messages"), F.count(F.lit(1)).alias("distinct_models"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= top_models, F.struct("i", named.alias("x"))))), lambda x: x["x"]), ",").alias("top_models"),
    )
    every = Window.partitionBy()
    g = g.withColumn("session_share", stats.ratio(F.col("sessions"), F.sum("sessions").over(every))).withColumn("message_share", stats.ratio(F.col("messages"), F.sum("messages").over(every)))
    return g.where(F.col("sessions") >= min_sessions)


def session_source_mix(sessions: DataFrame, unit: str = "day", top: int = 0, exclude=(), **window) -> DataFrame:
    """Sessions by (bucket, source) with shares; sources after the first ``top`` fold into ``other``."""
    s = _session_rows(sessions, **window).withColumn("source", dims.or_unknown("source"))
    if exclude:
        s = s.where(~F.col("source").isin(*exclude))
    s = s.withColumn("bucket", F.to_date(F.date_trunc(unit, "started_at")).cast("string"))
    if top:
        largest = s.groupBy("source").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "source").limit(top).select(F.col("source").alias("_top"))
        s = s.join(F.broadcast(largest), F.col("source") == F.col("_top"), "left").withColumn("source", F.coalesce("_top", F.lit("other")))
    g = s.groupBy("bucket", "source").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("bucket")
    g = g.withColumns({"total_sessions": F.sum("count").over(w), "unique_sources": F.count(F.lit(1)).over(w)})
    first = F.first("source").over(w.orderBy(F.desc("count"), "source"))
    return g.withColumn("share", F.col("count") / F.col("total_sessions")).withColumn("modal_source", first)
