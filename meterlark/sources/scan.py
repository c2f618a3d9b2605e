"""Scans of JSON logs that count what they skip and know where each row stood."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Place of a line: its file, the split of the file, and its number in the split. Places sort as the file does.
POSITION = "struct<file:string,block:bigint,row:bigint>"


def scan(spark: SparkSession, path: str, schema: T.StructType, whole: bool = False) -> DataFrame:
    """Every line that is not blank, or with ``whole`` every file, as a row of ``schema``.

    Besides the schema's columns: ``_malformed`` (no JSON object), ``_line`` (the text of such a line)
    and ``_position``. A field that is no text, number or time of its type is null, and its row stays:
    numbers may be given as text, and fractions are cut off. A missing path is an empty log. Long
    files are split, so that one log is read by many tasks.
    """
    try:
        text = spark.read.text(path, wholetext=whole)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        text = spark.createDataFrame([], "value string").withColumn("_position", F.lit(None).cast(POSITION))
    else:
        place = F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        )
        text = text.select("value", place.alias("_position"))
    names = [f.name for f in schema]
    texts = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", texts, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = text.where(F.trim("value", F.lit(" \t\r\n")) != "").withColumn("_json", parsed)
    bad = F.col("_json").isNull() | F.col("_json._bad").isNotNull()
    return rows.select(*[_typed(f) for f in schema], bad.alias("_malformed"), F.when(bad, F.col("value")).alias("_line"), "_position")


def _typed(field: T.StructField):
    value = F.col("_json").getField(field.name)
    if isinstance(field.dataType, T.LongType):
        value = value.try_cast("double").try_cast("long")
    elif isinstance(field.dataType, T.TimestampType):
        value = F.try_to_timestamp(value)
    return value.alias(field.name)


def rows_of(scanned: DataFrame, position: bool = False) -> DataFrame:
    """The rows of a scan that are well formed, with ``_position`` if wanted."""
    return scanned.where("not _malformed").drop("_malformed", "_line", *([] if position else ["_position"]))


def counts(scanned: DataFrame) -> DataFrame:
    """(file, lines, malformed, first_malformed): per file the lines that are not blank, those that are no
    JSON object, and the first of these."""
    bad = F.when(F.col("_malformed"), F.struct(F.col("_position.block").alias("b"), F.col("_position.row").alias("r"), F.col("_line").alias("line")))
    return scanned.groupBy(F.col("_position.file").alias("file")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("_malformed").alias("malformed"), F.min(bad)["line"].alias("first_malformed")
    )
