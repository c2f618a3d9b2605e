"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per
digest (with partial aggregation, so a hot group costs one row per task) and dealt as the
buckets are; what a sort-merge anti-join does not find in the index is appended. Where
better rows may replace those kept, a better one is appended as a new version of its
digest. Which row stays is read back from the index by a sort-merge join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents, lookup, text_or_empty

INDEX = T.StructType(
    [
        T.StructField("text_sha256", T.StringType()),
        T.StructField("keep_id", T.LongType()),
        T.StructField("keep_row", T.LongType()),
        T.StructField("keep_chars", T.LongType()),
        T.StructField("batch", T.StringType()),
    ]
)


def digest(text: Column) -> Column:
    """SHA-256 of the text without ASCII white space (space, and tab to carriage return)."""
    return F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), 256)


def _order(chars: str, keep_id: str) -> Column:
    """Of equal texts the smallest stays: most code points, then smallest id, null last."""
    return F.struct((-F.col(chars)).alias("c"), F.col(keep_id).isNull().alias("n"), F.col(keep_id).alias("i"))


def digested(docs: DataFrame, id_col: str, text_col: str, more: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``docs`` written with a digest and a number each: _id, _chars, text_sha256, _row, _more."""
    text = text_or_empty(text_col)
    return cut(
        docs.select(
            F.col(id_col).cast("long").alias("_id"), F.char_length(text).cast("long").alias("_chars"), digest(text).alias("text_sha256"),
            F.monotonically_increasing_id().alias("_row"), F.struct(F.lit(0).alias("_"), *more).alias("_more"),
        )
    )


class DigestIndex:
    """A bucketed table of the digests seen so far, kept in the warehouse.

    A row is a version of a digest: the best row of the batch that brought it. Without
    replacement a digest has one version.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 48):
        self.spark, self.table, self.buckets = spark, table, buckets

    def _write(self, rows: DataFrame, table: str | None = None) -> None:
        rows.write.format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").mode("append").saveAsTable(table or self.table)

    def entries(self) -> DataFrame:
        """All versions."""
        if not self.spark.catalog.tableExists(self.table):
            self._write(self.spark.createDataFrame([], INDEX))
        return self.spark.table(self.table)

    def current(self) -> DataFrame:
        """The best version of each digest: buckets hold whole digests, so nothing is exchanged."""
        best = F.min_by(F.struct("keep_id", "keep_row", "keep_chars", "batch"), _order("keep_chars", "keep_id"))
        return self.entries().groupBy("text_sha256").agg(best.alias("b")).select("text_sha256", "b.*")

    def reduced(self, rows: DataFrame) -> DataFrame:
        """One row per digest of ``digested`` rows: text_sha256, keep_id, keep_row, keep_chars, group_size."""
        best = F.struct(_order("_chars", "_id").alias("o"), F.col("_row").alias("r"))
        groups = rows.groupBy("text_sha256").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
        picked = groups.select("text_sha256", F.col("best.o.i").alias("keep_id"), F.col("best.r").alias("keep_row"), (-F.col("best.o.c")).alias("keep_chars"), "group_size")
        return cut(picked)

    def _dealt(self, groups: DataFrame) -> DataFrame:
        """Dealt as the buckets are, so that the index is read in place however many shuffle partitions are set."""
        return groups.repartition(self.buckets, "text_sha256")

    def unknown(self, groups: DataFrame) -> DataFrame:
        """``reduced`` rows whose digest the index does not have: a sort-merge anti-join."""
        return self._dealt(groups).join(self.entries().select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def better(self, groups: DataFrame) -> DataFrame:
        """``reduced`` rows of known digests that come before the version that the index keeps."""
        kept = self.current().select("text_sha256", _order("keep_chars", "keep_id").alias("_kept"))
        return self._dealt(groups).join(kept.hint("merge"), "text_sha256").where(_order("keep_chars", "keep_id") < F.col("_kept")).drop("_kept")

    def append(self, groups: DataFrame, batch: str, replace: bool = False) -> None:
        """Append what is new in ``reduced`` rows and, with ``replace``, what is better. Doing it again appends nothing."""
        fresh = self.unknown(groups)
        if replace:
            fresh = fresh.unionByName(self.better(groups))
        # One task per bucket, so a batch adds one sorted file to each.
        self._write(self._dealt(cut(fresh)).select("text_sha256", "keep_id", "keep_row", "keep_chars", F.lit(batch).alias("batch")))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None, more: tuple[str, ...] = (), replace: bool = False) -> DataFrame:
        """Deduplicate a batch against the index and append what is new.

        Returns one row per input row: ``id_col``, keep_id, group_size (rows of this
        batch with the digest), kept, text_sha256 and the columns ``more``. Within a batch
        the longest original text (code points), then the smallest id, stays, and of
        repeated rows one. A digest that the index has from another batch keeps the
        index's row, so the batch's rows go; with ``replace`` only unless the batch has a
        better one, which then is the digest's new version. Null texts count as empty; a
        null id is the largest.

        ``batch`` names the rows for a rerun: one that failed after the append decides
        as it did before and appends nothing twice. Without it each call is a new batch.
        """
        batch = batch or uuid.uuid4().hex
        rows = digested(docs, id_col, text_col, more)
        groups = self.reduced(rows)
        self.append(groups, batch, replace)
        index = self.current().select("text_sha256", F.col("keep_id").alias("index_id"), F.col("batch").alias("index_batch"))
        # The row by its number in this run: a rerun may number the rows in another way.
        own = F.when(F.col("index_batch") == batch, F.col("keep_row"))
        decided = self._dealt(groups).join(index.hint("merge"), "text_sha256").select("text_sha256", F.col("index_id").alias("keep_id"), own.alias("keep_row"), "group_size")
        return _decisions(rows, cut(decided), id_col, more)

    def compact(self) -> None:
        """Rewrite the table with one sorted file per bucket and one version per digest, after many appends."""
        fresh = f"{self.table}_compacted"
        self.spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        self._write(self._dealt(self.current()), fresh)
        self.drop()
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {self.table}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _decisions(rows: DataFrame, decided: DataFrame, id_col: str, more: tuple[str, ...]) -> DataFrame:
    """``digested`` rows with what was decided of their digests (text_sha256, keep_id, keep_row, group_size)."""
    found = lookup(rows, decided, "text_sha256", "group_size", rows.count(), "_id")
    kept = F.coalesce(F.col("_row") == F.col("keep_row"), F.lit(False)).alias("kept")
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", kept, "text_sha256", *[F.col("_more")[c].alias(c) for c in more])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = (), batches: int = 2) -> DataFrame:
    """All rows of ``docs`` through an index of their own, in ``batches`` that together are the whole table.

    Each batch is anti-joined with what those before left in the index, and appended: new
    digests, and better rows as new versions. Once all are in, the row of each digest is
    read from the index, so the result does not depend on how rows fell to batches.
    group_size counts the rows of all batches. The index is dropped: all decisions are written.
    """
    index = DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}")
    try:
        rows = digested(docs, id_col, text_col, more)
        part = F.pmod(F.xxhash64("_row"), F.lit(batches))
        groups = [index.reduced(rows.where(part == k)) for k in range(batches)]
        for k, group in enumerate(groups):
            index.append(group, str(k), replace=True)
        sizes = groups[0]
        for group in groups[1:]:
            sizes = sizes.unionByName(group)
        sizes = sizes.groupBy("text_sha256").agg(F.sum("group_size").alias("group_size"))
        decided = index._dealt(sizes).join(index.current().hint("merge"), "text_sha256").select("text_sha256", "keep_id", "keep_row", "group_size")
        return _decisions(rows, cut(decided), id_col, more)
    finally:
        index.drop()


def op2_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its group that stays, by an index to which the table is added in
    two batches. Repeated rows with one id are rows of their own, of which one has ``kept``; null texts
    are empty; an empty table gives no rows."""
    return deduplicated(documents(spark, sf_dir))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), h AS (
  SELECT doc_id, length(t) AS chars, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
    row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS nth, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM g
"""
