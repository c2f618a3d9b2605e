"""Near copies by SimHash and the exact similarity of their word shingles.

A text is the set of its shingles' hashes, which has a SimHash. Sets whose fingerprints are
at most two bits apart are found by the pivots' distance tables (``simhash.links``) and
verified by their whole sets; what is verified is one class and is not compared again.

Not all texts of a similarity of 0.8 lie so near (some are fifteen bits apart, further than
pivots can index), so links between classes are found another way. The smallest of a
set's hashes, a bit over (1 - p / q) of them, are its sketch. Two sets of a similarity of
p / q share a fixed number of sketch hashes, so

1. sketch hashes are counted once; texts with too few shared ones go;
2. the whole sets of the few that are left are counted; texts whose shared shingles are
   not at least p / q of their own go;
3. what is left meets under its rarest shared sketch hashes (a prefix filter), if its
   classes differ.

Each set has a fingerprint of 1,024 bits, a bit for the parity of the shingles that fall
on it. Two fingerprints never differ in more bits than their sets differ in shingles, so
the Hamming distance discards most pairs for certain; survivors are verified by their
whole sets. Hashes that many sets meet under are not paired at once: sets are compared
with the nearest of the few chosen under their hashes, and only those that stay in
different components are then paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, cut, lookup, text_or_empty
from .components import components, key_links
from .simhash import links as fingerprint_links
from .simhash import set_fingerprint

SEED = 42
#: A hash with more sets is handled by components; chosen sets that each is compared with.
PAIRED, LEADS = 8, 2
#: Words of 64 bits in a parity fingerprint.
WORDS = 16
#: Added to a sketch: 1 / EXTRA of the set's size.
EXTRA = 10


def shingles(text: str, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a shorter text is one shingle, one without words none."""
    ws = text.encode().lower().split()
    if not ws:
        return np.empty(0, np.int64)
    parts = map(b" ".join, zip(*(ws[i:] for i in range(words)), strict=False)) if len(ws) >= words else [b" ".join(ws)]
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in parts], "<u8").view(np.int64))


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def parity(own: np.ndarray) -> np.ndarray:
    """The fingerprint of a set: which of its bits an odd number of hashes falls on."""
    odd = np.bincount(own & (64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _least(n: int, p: int, q: int) -> int:
    """Shingles that a set of n and one similar to it have in common, at the fewest."""
    return -(-n * p // q)


def _sketch_size(n: int, p: int, q: int) -> int:
    t = _least(n, p, q)
    return n - t + min(t, n // EXTRA + 1) if n else 0


def _sketches(rows: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """(_id, digest, node, size, fp, mask, first) of each of ``rows`` (_id, digest, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column("t")]
            made = [
                pa.array([_node(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_fingerprint(s) for s in sets], pa.int64()),
                pa.array([parity(s) for s in sets], pa.list_(pa.int64())),
                pa.array([s[: _sketch_size(len(s), p, q)] for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("digest"), *made], ["_id", "digest", "node", "size", "fp", "mask", "first"])

    return rows.mapInArrow(run, "_id long, digest long, node long, size long, fp long, mask array<long>, first array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, own): the whole set of each of ``texts`` (t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "own"])

    return texts.select("t").mapInArrow(run, "node long, own array<long>")


def _shared(keyed: DataFrame) -> DataFrame:
    """(key, members) of the keys that more than one row of ``keyed`` has, written."""
    return cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))


def _with_members(keyed: DataFrame, counts: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``keyed`` whose key is in ``counts``, with members."""
    total = counts.agg(F.sum("members")).first()[0] or 0
    return lookup(among(keyed, "key", counts, "key"), counts, "key", "members", total, "node").where("members is not null").select("key", *columns, "members")


def _fewest(size: Column, p: int, q: int) -> Column:
    """Sketch hashes that a set shares with any similar one, at the fewest (of the smallest such set)."""
    other = F.ceil(size * p / q)
    return F.least(F.ceil(other * p / q), F.floor(other / EXTRA) + 1)


def _candidates(nodes: DataFrame, firsts: DataFrame, texts: DataFrame, words: int, p: int, q: int) -> tuple[DataFrame, DataFrame]:
    """(key, node): where similar sets meet; and (node, own): the whole sets of those that may have a similar one."""
    keyed = firsts.select("node", "size", F.explode("first").alias("key"))
    # Repeated rows of one set count here, which only adds texts that step 2 takes out.
    met = cut(_with_members(keyed, _shared(keyed), "node", "size").distinct())
    likely = met.groupBy("node").agg(F.count(F.lit(1)).alias("have"), F.first("size").alias("size")).where(F.col("have") >= _fewest(F.col("size"), p, q))
    chosen = cut(likely.join(nodes.select("node", "digest"), "node").select("node", "size", "have", "digest"))

    wanted = chosen.select(F.col("digest").alias("_digest")).distinct()
    sets = among(texts, "digest", wanted, "_digest").join(wanted, F.col("digest") == F.col("_digest"), "left_semi").dropDuplicates(["digest"])
    sets = cut(_sets(sets, words))
    whole = sets.select("node", F.explode("own").alias("key"))
    part = among(whole, "key", _shared(whole), "key").groupBy("node").agg(F.count(F.lit(1)).alias("common"))
    strong = cut(chosen.join(part, "node").where(F.col("common") >= F.ceil(F.col("size") * p / q)).select("node", "have", "size"))

    # Of m shared hashes, of which at least f are common to a pair, one is among the m - f + 1 rarest.
    rare = met.select("node", "key", "members").join(strong, "node").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("members", "key"))).alias("keys"), F.first("size").alias("size")
    )
    count = F.greatest(F.lit(0), F.size("keys") - _fewest(F.col("size"), p, q) + 1).cast("int")
    return cut(rare.select("node", F.explode(F.slice("keys", F.lit(1), count)).alias("k")).select("k.key", "node")), sets


def _apart(a: str, b: str) -> Column:
    """Bits in which two parity fingerprints differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(WORDS)), F.lit(0))


def _possible(p: int, q: int) -> Column:
    """Whether (size, mask) and (size2, mask2) may belong to similar sets."""
    fits = q * F.least("size", "size2") >= p * F.greatest("size", "size2")
    return fits & ((p + q) * _apart("mask", "mask2") <= (q - p) * (F.col("size") + F.col("size2")))


def _verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Those of distinct ``pairs`` (u, v) whose whole sets have the similarity."""
    x, y = (sets.select(F.col("node").alias(side), F.col("own").alias(name)) for side, name in (("u", "x"), ("v", "y")))
    both = pairs.join(x, "u").join(y, "v")
    return cut(both.where((p + q) * F.size(F.array_intersect("x", "y")) >= p * (F.size("x") + F.size("y"))).select("u", "v"))


def near_fingerprints(nodes: DataFrame, p: int, q: int) -> DataFrame:
    """(u, v) with u < v: sets of ``nodes`` (node, size, fp, mask) whose fingerprints are at most two bits
    apart, without those that cannot be similar. Sets of one fingerprint are compared with the
    smallest of them, which also stands for them among others."""
    classes = cut(nodes.groupBy("fp").agg(F.min_by(F.struct("node", "size", "mask"), "node").alias("o"), F.count(F.lit(1)).alias("c")))
    heads = classes.select("fp", "c", *[F.col("o")[c].alias(f"{c}2") for c in ("node", "size", "mask")])
    equal = lookup(nodes.select("fp", "node", "size", "mask"), heads, "fp", "c", nodes.count(), "node").where("node <> node2")
    x = heads.select(F.col("fp").alias("u"), F.col("node2").alias("node"), F.col("size2").alias("size"), F.col("mask2").alias("mask"))
    y = heads.withColumnRenamed("fp", "v")
    close = fingerprint_links(classes.select("fp")).join(x, "u").join(y, "v")
    columns = ("node", "size", "mask", "node2", "size2", "mask2")
    both = equal.select(*columns).unionByName(close.select(*columns)).where(_possible(p, q))
    return both.select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v"))


def links(nodes: DataFrame, firsts: DataFrame, texts: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """(u, v): enough pairs of similar sets to join exactly those that chains of similar pairs join.

    ``nodes``: (node, size, digest, fp, mask) once each; ``firsts``: (node, size, first);
    ``texts``: (digest, t).
    """
    keyed, sets = _candidates(nodes, firsts, texts, words, p, q)
    # A set that is not among ``sets`` has no similar one.
    known = _verified(near_fingerprints(nodes, p, q), sets, p, q)
    classes = components(known).withColumnRenamed("root", "class")
    counts = _shared(keyed)
    total = counts.agg(F.sum("members")).first()[0] or 0
    met = lookup(keyed, counts, "key", "members", total, "node").where("members is not null")
    met = met.join(nodes.select("node", "size", "mask"), "node").join(classes, "node", "left")
    met = cut(met.withColumn("class", F.coalesce("class", "node")))

    possible = (F.col("class") != F.col("class2")) & _possible(p, q)
    return key_links(met, possible, _apart("mask", "mask2"), lambda pairs: _verified(pairs, sets, p, q), F.lit(0), PAIRED, LEADS, known)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row per row: ``id_col``, digest (of the text), component_id (smallest id reachable), group (of
    the component: differs between components that have equal ids).

    Rows link where the Jaccard similarity of their sets of ``words``-word shingles is
    at least ``similarity`` (a fraction); chains count. Those whose SimHash differs in at most
    two bits are found by pivots, the others by sketches; all are verified. Words are lower case in ASCII and
    parted by ASCII white space. Texts without words link to each other; null texts
    count as empty. A null id is never smallest unless all are null. An empty table
    gives no rows; other columns are ignored.
    """
    p, q = similarity
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("t")).withColumn("digest", F.xxhash64("t"))
    rows = cut(_sketches(texts.select("_id", "digest", "t"), words, p, q))
    nodes = cut(rows.groupBy("node").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("digest").alias("digest"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("mask").alias("mask")))
    found = components(links(nodes, rows.select("node", "size", "first"), texts.select("digest", "t"), words, p, q))
    linked = found.join(nodes.select("node", "least"), "node")
    roots = linked.groupBy("root").agg(F.min("least").alias("component"))
    of = linked.join(roots, "root").select("node", "component", "root")
    named = cut(nodes.join(of, "node", "left").select("node", F.coalesce("component", "least").alias("component_id"), F.coalesce("root", "node").alias("group"), "n"))
    total = named.agg(F.sum("n")).first()[0] or 0
    out = lookup(rows.select("_id", "digest", "node"), named, "node", "n", total, "_id")
    return out.select(F.col("_id").alias(id_col), "digest", "component_id", "group")
