"""The folder that all executors share, and frames that are written there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only on a local master where it is unset is a folder chosen here."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-shared-")


def written(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, so that neither its rows nor their parts move when a task runs again."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of a caller's table that is broadcast at most.
SMALL = 100_000


def if_small(table: DataFrame) -> DataFrame:
    """``table`` with a broadcast hint if it has at most ``SMALL`` rows, which are counted; a larger one joins as Spark decides."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table
