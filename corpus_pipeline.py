"""A corpus made ready for training: quality, exact dedup, near dedup, packing."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.llm.common import cut, text_or_empty
from meterlark.llm.exact_dedup import deduplicated
from meterlark.llm.packing import pack
from meterlark.llm.quality import accepted
from meterlark.llm.simhash import near_duplicates

#: Chunks that a worker remembers in packing: the stages before have left an executor less memory than it has for packing alone.
KNOWN = 100_000

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a digest of each text, since rows of one doc_id may differ."""
    return docs.select(*COLUMNS, F.xxhash64(text_or_empty("text")).alias("digest"))


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of keyed ``docs`` for each (doc_id, digest) of ``kept``. A null id equals a null id."""
    key = (F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.col("digest").alias("_digest"))
    # Plain columns as keys: the rows are dealt once, for the join and for the choice of one row.
    rows = docs.select("*", *key).join(kept.select(*key), ["_id", "_null", "_digest"], "left_semi")
    return rows.dropDuplicates(["_id", "_null", "_digest"]).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, each judged by its own text: null and empty texts have a
    score too, repeated rows go or stay together, an empty table stays empty."""
    return accepted(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the one of the smallest id (null last);
    one of repeated rows. Null texts count as empty."""
    docs = _keyed(docs)
    return _keep(docs, deduplicated(docs, more=("digest",)).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: SimHash of five-word shingles and
    pivots, verified by a similarity of 0.8, and sketches for those more than two bits apart. Texts without
    words are one group; one of repeated rows stays; null ids are last."""
    found = near_duplicates(docs, words=5, similarity=(4, 5))
    # Texts of one id in one group: the one of the smallest digest.
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "group").agg(F.min("digest").alias("digest"))
    return _keep(_keyed(docs), kept)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids and places in sequences; null texts have the end id alone."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), known=KNOWN)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("packing", packed)]

#: SQL has no tokenizer and no classifier; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each over all that the one before kept, which is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            if folder:
                path = os.path.join(folder, f"pipeline-{uuid.uuid4().hex}")
                docs.write.parquet(path)
                docs = spark.read.parquet(path)
            else:
                docs = cut(docs)
    return docs
