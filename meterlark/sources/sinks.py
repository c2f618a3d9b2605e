"""Exports as files: CSV or one JSON object a line, in files of bounded size, and their check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one file at most.
ROWS = 5_000_000
_CSV = {"header": True, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "", "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write(rows: DataFrame, path: str, kind: str = "csv", by: str | None = None, most_rows: int = ROWS, mode: str = "error") -> None:
    """Write ``rows`` to a folder as ``csv`` (a header in each file, quotes doubled, null as an empty cell) or ``ndjson`` (nulls kept).

    No file has more than ``most_rows`` rows. With ``by`` there is a folder for each value of that column,
    in whose files the column is missing; the rows of a value stay with the tasks that have them, so a
    value with a third of all rows is written by many tasks.
    """
    out = rows.write.mode(mode).option("maxRecordsPerFile", most_rows)
    out = out.partitionBy(by) if by else out
    if kind == "csv":
        out.options(**_CSV).csv(path)
    elif kind == "ndjson":
        out.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"no such format: {kind}")


def read(spark: SparkSession, path: str, schema: T.StructType, kind: str = "csv") -> DataFrame:
    """The rows of an export; an unreadable line is an error. Empty cells of CSV are null."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", False)
    return reader.options(**_CSV, multiLine=True).csv(path) if kind == "csv" else reader.json(path)


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row: how many rows, and a sum of their hashes that no order changes; empty texts count as null."""
    values = [F.nullif(F.col(f.name), F.lit("")) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in rows.schema]
    return rows.select(F.xxhash64(*values).cast("decimal(20,0)").alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)")).alias("hashes"))


def export(rows: DataFrame, path: str, kind: str = "csv", by: str | None = None, most_rows: int = ROWS, mode: str = "error") -> DataFrame:
    """``write``, then read the files back: the rows as read, in ``rows``' columns. ValueError if they differ from what was written."""
    write(rows, path, kind, by, most_rows, mode)
    back = read(rows.sparkSession, path, rows.schema, kind).select(*rows.columns)
    want, got = fingerprint(rows).first(), fingerprint(back).first()
    if want != got:
        raise ValueError(f"{path} holds {got['rows']} rows that differ from the {want['rows']} written")
    return back
