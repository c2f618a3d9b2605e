"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder and read from there.

    The folder is ``spark.checkpoint.dir``; only where that is unset on a local master
    (tests, a laptop) is one chosen here. On a cluster an unset folder is an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, only on a local master one chosen here."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-shared-")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def among(rows: DataFrame, column: str, wanted: DataFrame, other: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not among ``wanted[other]``.

    A bitmap of 2^24 hashed values, so at most 2^18 words whatever the input, is
    broadcast; only what passes it has to shuffle. With more than some 2^24 wanted
    values it passes most rows, and the join that follows does the work.
    """

    def word(c: str) -> Column:
        return F.pmod(F.shiftright(F.xxhash64(c), 6), F.lit(1 << 18))

    def bit(c: str) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(c).bitwiseAND(F.lit(63)).cast("int"))

    words = wanted.select(word(other).alias("_word"), bit(other).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.join(F.broadcast(words), (word(column) == F.col("_word")) & (bit(column).bitwiseAND(F.col("_bits")) != 0))
    return met.select(*rows.columns)


#: A key with more than 1/HOT_PARTS of all rows is hot; so there are at most HOT_PARTS hot keys.
HOT_PARTS = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, spread: str) -> DataFrame:
    """Left join ``rows`` with ``table`` (one row per ``key``), safe for hot keys.

    ``weight`` is the table's column that says how many of ``rows`` have the key.
    Keys with more than a thousandth of all ``total`` rows number fewer than a
    thousand, whatever the input, and are broadcast; their rows then shuffle by
    ``spread`` (any well spread column) and meet nothing. The rest joins by shuffle.
    """
    least = max(1, total // HOT_PARTS)
    values = [c for c in table.columns if c != key]
    hot = table.where(F.col(weight) > least).select(
        F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot")
    )
    cold = table.where(F.col(weight) <= least).select(
        F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold")
    )
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    hot_rows = F.col("_hot_key").isNotNull()
    kind = dict(table.dtypes)[key]
    # xxhash64 of the spread column stands for the key of a hot row; the flag keeps it from meeting a real key.
    marked = marked.withColumn("_is_hot", hot_rows).withColumn(
        "_join_key", F.when(hot_rows, F.xxhash64(spread).cast(kind)).otherwise(F.col(key))
    )
    joined = marked.join(
        cold.withColumn("_cold_flag", F.lit(False)),
        (F.col("_join_key") == F.col("_cold_key")) & (F.col("_is_hot") == F.col("_cold_flag")),
        "left",
    )
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*rows.columns, *[found[v].alias(v) for v in values])
