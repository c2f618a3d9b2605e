"""Histogram sort into shards of near-equal bytes (DataFrame operations only).

Rows are ordered by (hash of the text, hash of the id and the row's place). Each round counts the
exact bytes below 4,096 candidate boundaries inside every open interval, over all
partitions, and keeps for each splitter the one interval that holds its target.
The loop ends when every splitter is within tolerance; the counts of one round are
at most 4,096 x (shards - 1) rows, whatever the input. Then rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, text_or_empty

#: Bits of the key that one round of probes resolves, and bits of each part of the key.
PROBE_BITS, KEY_BITS = 12, 64
LOWEST = -(1 << 63)


@dataclass(frozen=True)
class Splitter:
    """Rows whose (text_key, id_key) is not below this belong to the right."""

    text_key: int
    id_key: int
    bytes_below: int


def _prefix(column: str, bits: int) -> Column:
    return F.shiftright(column, KEY_BITS - bits) if bits < KEY_BITS else F.col(column)


def _refine(rows: DataFrame, column: str, targets: dict[int, tuple[int, int, int | None]], tolerance: float, text_keys: dict[int, int] | None) -> dict[int, tuple[int, int, int]]:
    """Search one part of the key.

    ``targets``: splitter -> (bytes wanted, bytes below the interval, prefix or None).
    Returns splitter -> (boundary, bytes below it, bytes of the key that follows the
    boundary, 0 if the boundary met the tolerance).
    """
    done, bits, open_ = {}, 0, {i: (want, below, ()) for i, (want, below, _) in targets.items()}
    while open_:
        at, bits = bits, min(KEY_BITS, bits + PROBE_BITS)
        inside = rows
        group = [_prefix(column, bits).alias("probe")]
        if text_keys is not None:
            inside = inside.where(F.col("text_key").isin(sorted({text_keys[i] for i in open_})))
            group.append(F.col("text_key").alias("text_key"))
        if at:
            inside = inside.where(_prefix(column, at).isin(sorted({p for _, _, p in open_.values()})))
        counted = inside.groupBy(*group).agg(F.sum("size").alias("bytes")).collect()
        of: dict = {}
        for r in counted:
            of.setdefault((r["text_key"] if text_keys is not None else None, r["probe"] >> (bits - at) if at else ()), []).append((r["probe"], r["bytes"]))
        for v in of.values():
            v.sort()
        still = {}
        for i, (want, below, prefix) in open_.items():
            bins = of[(text_keys[i] if text_keys is not None else None, prefix)]
            sums, total = [], below
            for _, b in bins:
                total += b
                sums.append(total)
            k = min(bisect_left(sums, want), len(bins) - 1)
            before, after, probe = (sums[k - 1] if k else below), sums[k], bins[k][0]
            shift = KEY_BITS - bits
            if want - before <= tolerance and want - before <= abs(after - want):
                done[i] = (probe << shift, before, 0)
            elif abs(after - want) <= tolerance and k + 1 < len(bins):
                done[i] = (bins[k + 1][0] << shift, after, 0)
            elif bits == KEY_BITS:
                done[i] = (probe, before, after - before)
            else:
                still[i] = (want, before, probe)
        open_ = still
    return done


def find_splitters(keys: DataFrame, shards: int, tolerance: float, group_tolerance: float) -> list[Splitter]:
    """Splitters for ``keys`` (text_key, id_key, size).

    A boundary within ``tolerance`` of the ideal shard's bytes ends the search. Equal
    texts are parted only where both ends of their group lie further than
    ``group_tolerance`` from the target.
    """
    total = keys.agg(F.sum("size").alias("bytes")).first()["bytes"] or 0
    if not total:
        return []
    ideal = total / shards
    wanted = {i: (round(total * i / shards), 0, None) for i in range(1, shards)}
    found = _refine(keys, "text_key", wanted, tolerance * ideal, None)
    out, parted = {}, {}
    for i, (key, below, group) in found.items():
        want = wanted[i][0]
        if not group or want - below <= min(group_tolerance * ideal, below + group - want):
            out[i] = Splitter(key, LOWEST, below)
        elif below + group - want <= group_tolerance * ideal and key < -(LOWEST + 1):
            out[i] = Splitter(key + 1, LOWEST, below + group)
        else:
            parted[i] = (want, below, None)
    if parted:
        of = {i: found[i][0] for i in parted}
        for i, (key, below, row) in _refine(keys, "id_key", parted, tolerance * ideal, of).items():
            nearer = below + row - parted[i][0] < parted[i][0] - below and key < -(LOWEST + 1)
            out[i] = Splitter(of[i], key + 1 if row and nearer else key, below + row * bool(nearer))
    return sorted(out.values(), key=lambda s: (s.text_key, s.id_key))


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, group_tolerance: float = 0.02) -> DataFrame:
    """Deal rows into ``shards`` of near-equal bytes, each sorted by key and numbered.

    Returns one row per input row: ``id_col``, size (UTF-8 bytes + 1; a null text has
    no bytes), text_crc32, shard, slot (gapless from 0 in the shard's key order).
    Sizes differ from the ideal by the tolerance or by the largest row at a boundary.
    Equal texts share a shard unless their group straddles a boundary by more than
    ``group_tolerance`` of a shard. Null ids and texts are ordinary values; repeated
    rows are kept, in any order among themselves; an empty table gives no rows; other
    columns are ignored.
    """
    text = text_or_empty(text_col)
    keys = cut(
        docs.select(
            F.col(id_col),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("text_key"),
            # Repeated rows of one id are told apart by their place in the input, written with them.
            F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).alias("id_key"),
        )
    )
    splitters = find_splitters(keys.select("text_key", "id_key", "size"), shards, tolerance, group_tolerance)
    shard = F.lit(0)
    for s in splitters:
        right = (F.col("text_key") > s.text_key) | ((F.col("text_key") == s.text_key) & (F.col("id_key") >= s.id_key))
        shard = shard + right.cast("int")
    rows = keys.withColumn("shard", shard)

    # Slots: a bin is a range of keys within a shard, of some thousand rows; its first slot is a running sum of the bins' counts.
    n = keys.count()
    id_bits = min(24, max(4, (n // 1000).bit_length()))
    bits = max(10, id_bits)
    hot = [r["text_key"] for r in keys.groupBy("text_key").count().where(F.col("count") > max(1000, n // 1000)).select("text_key").collect()]
    prefix = F.shiftright("text_key", KEY_BITS - bits)
    has_hot = prefix.isin(sorted({k >> (KEY_BITS - bits) for k in hot})) if hot else F.lit(False)
    is_hot = F.col("text_key").isin(sorted(hot)) if hot else F.lit(False)
    rows = rows.withColumns(
        {
            "bin": prefix,
            "bin_text": F.when(has_hot, F.col("text_key")).otherwise(F.lit(0)),
            "bin_id": F.when(is_hot, F.shiftright("id_key", KEY_BITS - id_bits)).otherwise(F.lit(0)),
        }
    )
    place = ["shard", "bin", "bin_text", "bin_id"]
    order = Window.partitionBy("shard").orderBy("bin", "bin_text", "bin_id")
    first = (
        rows.groupBy(*place)
        .agg(F.count(F.lit(1)).alias("in_bin"))
        .withColumn("first_slot", F.sum("in_bin").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .select(*place, F.coalesce("first_slot", F.lit(0)).alias("first_slot"))
    )
    inside = Window.partitionBy(*place).orderBy("text_key", "id_key", id_col)
    return (
        rows.withColumn("in_bin", F.row_number().over(inside) - 1)
        .join(first, place)
        .select(id_col, "size", "text_crc32", "shard", (F.col("first_slot") + F.col("in_bin")).cast("long").alias("slot"))
    )


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of near-equal bytes and its slot there; nulls, repeated rows and empty
    tables as in ``shard_by_bytes``."""
    dealt = shard_by_bytes(documents(spark, sf_dir))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
