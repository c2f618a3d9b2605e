"""Dimensions of a log row as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

# Names that stand for no model, and prefixes of which one is cut off.
PLACEHOLDERS = ("<synthetic>", "opus", "big-pickle", "synthetic")
PREFIXES = ("github_copilot/", "github.copilot-chat/", "copilot/", "openrouter/")
# USD per million tokens: input, cached input, output, reasoning.
DEFAULT_RATES = (
    ("claude-opus-4.7", 15.00, 1.50, 75.00, 75.00),
    ("claude-sonnet-4.6", 3.00, 0.30, 15.00, 15.00),
    ("gpt-5.4", 5.00, 0.50, 15.00, 15.00),
    ("gpt-5.2", 2.50, 0.25, 7.50, 7.50),
    ("gpt-5-nano", 0.20, 0.02, 0.80, 0.80),
)
# Patterns of normalised model names by provider.
PROVIDERS = (
    ("anthropic", r"^(claude-|claude$)"),
    ("openai", r"^(gpt-|gpt$|chatgpt-|o[134](?:[-.]|$))"),
    ("google", r"^(gemini-|palm-|bard-)"),
    ("meta", r"^(llama-|llama3|llama4)"),
    ("mistral", r"^(mistral-|mixtral-|codestral-)"),
    ("xai", r"^(grok-|grok$)"),
    ("deepseek", r"^deepseek-"),
    ("qwen", r"^(qwen-|qwen2|qwen3)"),
    ("cohere", r"^(command-|cohere-)"),
)


def or_unknown(column: str) -> Column:
    return F.when(F.col(column).isNull() | (F.col(column) == ""), "unknown").otherwise(F.col(column))


def normalise_model(column: str) -> Column:
    """One name for the spellings of a model; no name and placeholders become ``unknown``."""
    raw = F.col(column)
    prefix = "(?i)^(" + "|".join(p.replace(".", r"\.") for p in PREFIXES) + ")"
    m = F.regexp_replace(F.lower(F.regexp_replace(raw, prefix, "")), r"\s+", "-")
    m = F.regexp_replace(m, r"-(\d{8})$", "")
    for _ in range(2):
        m = F.regexp_replace(m, r"(\d)-(\d)", "$1.$2")
    none = raw.isNull() | (raw == "") | raw.isin(*PLACEHOLDERS)
    return F.when(none, "unknown").when(m.isin(*PLACEHOLDERS), "unknown").otherwise(m)


def provider(model: Column) -> Column:
    """Provider of a normalised model."""
    out = F.when(model.isNull() | (model == "unknown"), "unknown")
    for name, pattern in PROVIDERS:
        out = out.when(F.lower(model).rlike(pattern), name)
    return out.otherwise("unknown")


def within(df: DataFrame, column: str, since=None, until=None) -> DataFrame:
    """Rows from ``since`` (inclusive) until ``until`` (exclusive), both UTC times or null."""
    kind = dict(df.dtypes)[column]
    if since is not None:
        df = df.where(F.col(column) >= _literal(since, kind))
    if until is not None:
        df = df.where(F.col(column) < _literal(until, kind))
    return df


def _literal(at: str, kind: str) -> Column:
    return F.lit(str(at).replace("T", " ").replace("Z", "")).cast(kind)


def iso(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_day(column: str) -> Column:
    return F.datediff(F.to_date(column), F.lit("1970-01-01").cast("date")).cast("long")


def epoch_second(column: str) -> Column:
    return epoch_day(column) * 86400 + F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)


def iso_of(second: Column) -> Column:
    """ISO text of a number of seconds since 1970."""
    rest = F.pmod(second, F.lit(86400))

    def two(x: Column) -> Column:
        return F.lpad(F.floor(x).cast("string"), 2, "0")

    return F.concat(day_of(F.floor(second / 86400)), F.lit("T"), two(rest / 3600), F.lit(":"), two((rest % 3600) / 60), F.lit(":"), two(rest % 60), F.lit(".000Z"))


def day_of(number: Column) -> Column:
    """ISO day of a number of days since 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), number.cast("int")).cast("string")


def rates(spark: SparkSession, table=DEFAULT_RATES) -> DataFrame:
    return spark.createDataFrame(list(table), "rate_model string, r_input double, r_cached double, r_output double, r_reasoning double")


def with_cost(df: DataFrame, rate_table: DataFrame, model: str = "model") -> DataFrame:
    """``df`` with the four costs and usd; a model without a rate costs 0. The rate table has one row
    per model; its size is checked before it is broadcast."""
    joined = df.join(storage.if_small(rate_table), F.col(model) == F.col("rate_model"), "left")
    parts = {
        "input": ("input_tokens", "r_input"), "cached": ("cached_input_tokens", "r_cached"),
        "output": ("output_tokens", "r_output"), "reasoning": ("reasoning_output_tokens", "r_reasoning"),
    }
    costs = {f"{k}_cost": F.coalesce(F.col(t) * F.col(r) / 1e6, F.lit(0.0)) for k, (t, r) in parts.items()}
    return joined.withColumns(costs).withColumn("usd", sum((F.col(c) for c in costs), F.lit(0.0)))


def epoch_milli(column: str) -> Column:
    seconds = epoch_day(column) * 86400 + F.hour(column) * 3600 + F.minute(column) * 60
    return seconds * 1000 + F.floor(F.extract(F.lit("SECONDS"), F.col(column)) * 1000).cast("long")


def effective_end(df: DataFrame) -> DataFrame:
    """``df`` with start_ms and end_ms: a session ends at its last message or after its length, whichever is later."""
    df = df.withColumns({"start_ms": epoch_milli("started_at"), "_last": epoch_milli("last_message_at")})
    by_length = F.col("start_ms") + 1000 * F.greatest(F.coalesce("duration_seconds", F.lit(0)), F.lit(0))
    return df.withColumn("end_ms", F.greatest("start_ms", F.coalesce("_last", "start_ms"), by_length)).drop("_last")
