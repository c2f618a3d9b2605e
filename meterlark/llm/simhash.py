"""SimHash near-dedup with pivot distance tables.

Distinct fingerprints get a table of Hamming distances to reference fingerprints
(pivots): a base pivot and, for each of four blocks of 16 bits, pivots that differ from
it within the block. A pivot's distance less the base's depends on its block alone, so
two fingerprints at most two bits apart agree in these numbers on at least two blocks:
they meet under one of six keys. Pairs whose largest coordinate difference exceeds the
radius cannot be within it (triangle inequality) and go; the rest is verified. Keys with
many fingerprints are not paired: their members meet at midpoints, the 65 values within
one bit of each, which links exactly those at most two bits apart and costs no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, lookup, text_or_empty
from .components import components

SEED, BITS, BLOCKS, RADIUS = 42, 64, 4, 2
PIVOTS_PER_BLOCK = 8
#: A key with more fingerprints is handled by midpoints.
PAIRED = 32


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots() -> tuple[int, list[list[int]]]:
    """The base pivot, and each block's pivots: the base with half of a block's bits flipped by rule."""
    base = xxhash.xxh64_intdigest(b"base", SEED)
    width = BITS // BLOCKS
    out = []
    for b in range(BLOCKS):
        own = []
        for j in range(PIVOTS_PER_BLOCK):
            order = sorted(range(width), key=lambda i: xxhash.xxh64_intdigest(f"{b} {j} {i}".encode(), SEED))
            own.append(base ^ sum(1 << (b * width + i) for i in order[: width // 2]))
        out.append(own)
    return base, out


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)


def majority(sums: np.ndarray, n: int) -> int:
    """The unsigned fingerprint of ``n`` hashes: the bits that over half of them have."""
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def set_fingerprint(own: np.ndarray, step: int = 1 << 16) -> int:
    """The SimHash, as a long, of a set of shingle hashes; zero of an empty one."""
    return _signed(majority(sum((ones(own[at : at + step]) for at in range(0, len(own), step)), np.zeros(BITS, np.int64)), len(own)))


def fingerprint(text: str, words: int = 3, step: int = 1 << 16) -> int:
    """The unsigned SimHash of a text's word shingles, ``step`` shingles at a time."""
    ws = text.encode().lower().split()
    if not ws:
        return 0
    n = max(1, len(ws) - words + 1)
    sums = np.zeros(BITS, np.int64)
    for at in range(0, n, step):
        part = ws[at : at + step + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(ws) >= words else [b" ".join(ws)]
        sums += ones(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8"))
    return majority(sums, n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp): the fingerprint of each row as a long. Null texts count as empty (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t.as_py(), words)) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(fps, pa.int64())], ["i", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), text_or_empty(text_col).alias("t"))
    return rows.mapInArrow(run, "i long, fp long").withColumnRenamed("i", id_col)


def _distance(fp: str, pivot: int) -> Column:
    return F.bit_count(F.col(fp).bitwiseXOR(F.lit(_signed(pivot)).cast("long")))


def distance_table(fps: DataFrame) -> DataFrame:
    """``fps`` (fp) with ``distances``: base pivot first, then the pivots of each block."""
    base, blocks = pivots()
    return fps.withColumn("distances", F.array(*[_distance("fp", p) for p in [base, *sum(blocks, [])]]))


def links(fps: DataFrame) -> DataFrame:
    """(u, v) with u < v: enough pairs of distinct ``fps`` (fp) within the radius to join
    exactly those that chains of such pairs join. Each pair is within the radius."""
    if RADIUS != 2:
        raise ValueError("the keys and midpoints are made for a radius of 2")
    table = distance_table(fps)

    def block(b: int) -> list[Column]:
        return [F.col("distances")[1 + b * PIVOTS_PER_BLOCK + j] - F.col("distances")[0] for j in range(PIVOTS_PER_BLOCK)]

    keys = F.array(*[F.xxhash64(F.lit(k), *block(a), *block(b)) for k, (a, b) in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS))])
    keyed = table.select("fp", F.explode(keys).alias("key"))
    sizes = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    n = sizes.agg(F.sum("members")).first()[0] or 0
    met = cut(lookup(keyed, sizes, "key", "members", n, "fp").where("members is not null"))

    side = distance_table(met.where(F.col("members") <= PAIRED).select("fp", "key"))
    other = side.select("key", F.col("fp").alias("fp2"), F.col("distances").alias("distances2"))
    apart = F.array_max(F.zip_with("distances", "distances2", lambda x, y: F.abs(x - y)))
    paired = (
        side.join(other, "key")
        .where("fp < fp2")
        .where(apart <= RADIUS)
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS)
        .select(F.col("fp").alias("u"), F.col("fp2").alias("v"))
    )

    crowded = met.where(F.col("members") > PAIRED).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(BITS)])
    middle = crowded.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("middle"))
    # At most 65 fingerprints share a midpoint.
    least = middle.groupBy("middle").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("c")).where("c > 1").select("middle", "u")
    near = middle.join(least, "middle").where("u < fp").select("u", F.col("fp").alias("v"))
    return paired.unionByName(near).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, similarity: tuple[int, int] | None = None) -> DataFrame:
    """One row per row: ``id_col``, component_id (smallest id reachable, itself included), and fp.

    Rows link where their fingerprints differ in at most two bits. Texts without words
    have fingerprint 0 and link like any other; null texts count as empty; repeated rows
    share their component. A null id is never smallest unless all are null. An empty
    table gives no rows; other columns are ignored.

    With a ``similarity`` (a fraction) rows link where the sets of their shingles are that
    similar: sets whose fingerprints are within the radius are found by these pivots and
    verified, those further apart by sketches. See ``similar_documents``, whose columns
    come back.
    """
    if similarity:
        from .similar import similar_documents  # which is built on this module

        return similar_documents(docs, id_col, text_col, words, similarity)
    rows = cut(fingerprints(docs, id_col, text_col, words).select(F.col(id_col).alias("_id"), "fp"))
    classes = cut(rows.groupBy("fp").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = components(links(classes.select("fp")))
    linked = found.join(classes, found["node"] == classes["fp"]).select("fp", "root", "least")
    roots = linked.groupBy("root").agg(F.min("least").alias("component"))
    of = linked.join(roots, "root").select("fp", "component")
    named = cut(classes.join(of, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"), "n"))
    total = named.agg(F.sum("n")).first()[0] or 0
    out = lookup(rows, named, "fp", "n", total, "_id")
    return out.select(F.col("_id").alias(id_col), "fp", "component_id")


def op3_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; nulls, repeated rows and empty tables as in ``near_duplicates``."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
