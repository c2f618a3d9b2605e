"""Usage rows made ready for the reports, and sums by bucket, day and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dims, storage

TOKENS = {"input_tokens": "input", "cached_input_tokens": "cached", "output_tokens": "output", "reasoning_output_tokens": "reasoning"}


def rows(usage: DataFrame, since=None, until=None, source=None, model=None) -> DataFrame:
    """Usage with its dimensions: source, model (normalised), raw_model, device, sec (the bucket's
    start), day, hour, dow (Monday 0) and numbers without nulls. Rows without a time go."""
    out = _shaped(dims.within(usage.where("hour_start is not null"), "hour_start", since, until))
    if source is not None:
        out = out.where(F.col("source") == source)
    return out.where(F.col("model") == model) if model is not None else out


def _shaped(usage: DataFrame) -> DataFrame:
    out = usage.select(
        dims.or_unknown("source").alias("source"), F.col("source").alias("raw_source"),
        dims.normalise_model("model").alias("model"), F.col("model").alias("raw_model"), dims.or_unknown("device_id").alias("device"),
        dims.epoch_second("hour_start").alias("sec"), dims.epoch_day("hour_start").alias("dayno"), F.hour("hour_start").alias("hour"),
        *[F.coalesce(F.col(k), F.lit(0)).alias(k) for k in TOKENS], F.coalesce("total_tokens", F.lit(0)).alias("total"),
    )
    return out.withColumns({"dow": F.pmod(F.col("dayno") + 3, F.lit(7)), "day": dims.day_of(F.col("dayno")), **{v: F.col(k) for k, v in TOKENS.items()}})


def by_model(usage: DataFrame, since=None, until=None, source=None, model=None) -> DataFrame:
    """Sums of ``rows`` by normalised model: events, total and the token counts.

    Rows are summed by the name as it stands in the log, and only those few names are normalised.
    """
    known = dims.within(usage.where("hour_start is not null"), "hour_start", since, until)
    known = known.where(dims.or_unknown("source") == source) if source is not None else known
    sums = {**TOKENS, "total_tokens": "total"}
    raw = known.groupBy("model").agg(F.count(F.lit(1)).alias("events"), *[F.sum(F.coalesce(F.col(k), F.lit(0))).alias(k) for k in sums])
    out = raw.groupBy(dims.normalise_model("model").alias("model")).agg(F.sum("events").alias("events"), *[F.sum(k).alias(k) for k in sums])
    out = out.withColumns({v: F.col(k) for k, v in sums.items()})
    return out.where(F.col("model") == model) if model is not None else out


def active(usage: DataFrame, **window) -> DataFrame:
    """``rows`` with tokens."""
    return rows(usage, **window).where("total > 0")


def buckets(usage: DataFrame, *keys: str, **window) -> DataFrame:
    """Tokens by ``keys`` and bucket start: one shuffle, and what follows runs on cells that time bounds."""
    return active(usage, **window).groupBy(*keys, "sec").agg(F.sum("total").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))


def days(usage: DataFrame, *keys: str, **window) -> DataFrame:
    return active(usage, **window).groupBy(*keys, "dayno").agg(F.sum("total").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))


def hours(usage: DataFrame, *keys: str, **window) -> DataFrame:
    """Tokens by ``keys`` and hour of the day."""
    return active(usage, **window).groupBy(*keys, "hour").agg(F.sum("total").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))


def grid(df: DataFrame, name: str, low: int, high: int) -> DataFrame:
    """The whole numbers low..high of a fixed period (days of a window, hours of a day)."""
    return df.sparkSession.range(low, high + 1).select(F.col("id").alias(name))


#: Why a row of the log is no cell, in the order of the tests.
REASONS = ("invalid_hour_start", "zero_tokens", "source_filter", "model_filter")


def _why(source=None, model=None):
    """The first reason to drop a shaped row, or null."""
    no = F.lit(False)
    tests = (
        F.col("sec").isNull(), F.col("total") <= 0, F.col("source") != source if source is not None else no,
        F.col("model") != model if model is not None else no,
    )
    return F.coalesce(*[F.when(test, name) for name, test in zip(REASONS, tests, strict=True)])


def _or_timeless(usage: DataFrame, since, until) -> DataFrame:
    """Rows of the window, and those without a time."""
    return usage.where("hour_start is null").unionByName(dims.within(usage.where("hour_start is not null"), "hour_start", since, until))


def counted(usage: DataFrame, *keys: str, time: str = "sec", since=None, until=None, source=None, model=None) -> tuple[DataFrame, DataFrame]:
    """(cells, counters) of one pass over the log: ``buckets`` (or with time ``dayno``, ``days``), and one row that
    says how many rows went for each reason.

    Dropped rows are cells of their reason in the same aggregation, which is written; time bounds both.
    """
    rows = _shaped(_or_timeless(usage, since, until)).withColumn("_why", _why(source, model))
    names = (*keys, time)
    both = rows.groupBy("_why", *[F.when(F.col("_why").isNull(), F.col(k)).alias(k) for k in names]).agg(F.sum("total").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))
    both = storage.written(both)
    counters = both.agg(*[F.coalesce(F.sum(F.when(F.col("_why") == r, F.col("n_rows"))), F.lit(0)).alias(f"dropped_{r}") for r in REASONS])
    return both.where("_why is null").drop("_why"), counters


def floors(found: DataFrame, counters: DataFrame, **reasons) -> DataFrame:
    """``found`` without the rows for which a reason holds, with ``counters`` and how many rows each reason dropped
    (the first that holds counts). If none is left, the counters stand alone in one row."""
    why = F.coalesce(*[F.when(test, name) for name, test in reasons.items()])
    marked = found.withColumn("_why", why)
    counts = marked.agg(*[F.count_if(F.col("_why") == name).alias(f"dropped_{name}") for name in reasons])
    return counters.crossJoin(counts).join(marked.where("_why is null").drop("_why"), F.lit(True), "left")


def drops(usage: DataFrame, since=None, until=None, source=None, model=None) -> DataFrame:
    """One row: how many rows ``active`` keeps, and how many go for each reason, in the order of the tests."""
    marked = _shaped(_or_timeless(usage, since, until)).select(_why(source, model).alias("r"))
    return marked.agg(F.count_if(F.col("r").isNull()).alias("kept_rows"), *[F.count_if(F.col("r") == r).alias(f"dropped_{r}") for r in REASONS])
