"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lookup


#: Edges up to which a centre's neighbours, even all of them, may meet in one task.
FEW = 1_000_000


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One half round; ``edges`` (u, v) once each, in any direction."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    if total <= FEW:
        # No centre has more rows than one task can sort: one exchange finds the smallest neighbour.
        joined = both.withColumn("m", F.least(F.min("v").over(Window.partitionBy("u")), "u"))
        centres = joined
    else:
        centres = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        joined = lookup(both, centres, "u", "degree", 2 * total, "v")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(centres.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node reachable.

    Both columns are long and not null. Loops and repeated edges do no harm; no edges give
    no rows. Each round is written to the shared folder; a round's centres with very many
    neighbours are looked up by broadcast (see ``lookup``).
    """
    edges = cut(edges.where("u <> v").distinct())
    while total := edges.count():
        edges = cut(_stars(edges, True, total))
        edges = cut(_stars(edges, False, total))
        # Done when each node has one edge to a root that has none.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        open_ = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)")
        if open_.isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _other(rows: DataFrame) -> DataFrame:
    """``rows`` with 2 after the names of all columns but key."""
    return rows.select("key", *[F.col(c).alias(f"{c}2") for c in rows.columns if c != "key"])


def key_links(met: DataFrame, possible: Column, apart: Column, verify: Callable[[DataFrame], DataFrame], first: Column, paired: int, leads: int = 2, known: DataFrame | None = None) -> DataFrame:
    """(u, v): enough verified pairs of nodes that share a key to join exactly those that all such pairs join.

    ``met``: key, node, members (rows of the key) and what ``possible`` and ``apart`` need, also
    with 2 after the names for the other node. ``possible`` may only discard pairs that
    ``verify`` would; ``apart`` says how likely a pair is. Nodes of a key with more than
    ``paired`` rows are compared with the nearest few of those chosen under their keys
    (smallest ``first``, then by hash); then only nodes outside the largest component of a
    key meet those of other components there. ``known`` are verified pairs that count as
    found; ``possible`` may discard what chains of them join.
    """

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v")).distinct()

    few = met.where(F.col("members") <= paired).drop("members")
    pairs = few.join(_other(few), "key").where("node < node2").where(possible).select("node", "node2")

    crowd = met.where(F.col("members") > paired).drop("members")
    more = [c for c in crowd.columns if c != "key"]
    lead = crowd.groupBy("key").agg(F.min_by(F.struct(*more), F.struct(first, F.xxhash64("node", "key"))).alias("o"), F.count(F.lit(1)).alias("c"))
    lead = cut(lead.select("key", "c", *[F.col("o")[c].alias(f"{c}2") for c in more]))
    stars = lookup(crowd, lead, "key", "c", lead.agg(F.sum("c")).first()[0] or 0, "node").where("node <> node2").where(possible)
    near = Window.partitionBy("node").orderBy("apart", "node2")
    stars = stars.select("node", "node2", apart.alias("apart")).distinct()
    stars = stars.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= leads).select("node", "node2")
    found = verify(ordered(pairs.unionByName(stars)))
    if known is not None:
        found = found.unionByName(known)
    if lead.isEmpty():
        return found

    named = cut(crowd.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node")))
    held = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    main = held.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", "main")
    open_ = cut(named.join(main, "key"))
    left = open_.where("root <> main").drop("main").join(_other(open_.drop("main")), "key").where("root <> root2").where(possible)
    return found.unionByName(verify(ordered(left)))
