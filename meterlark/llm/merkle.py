"""Merkle manifest of a dataset, kept as a persistent path-copying tree.

Rows are leaves of one binary tree per partition value (``tree``); the trees' roots are the leaves of
a last tree above them. A tree is cut into aligned blocks of 2^``bits`` nodes, each of which one task
reduces to its root; the roots are the next level, cut into blocks again. So a level is a shuffle of
1/2^bits of the rows of the one below, no task holds more than a block, and only counts reach the driver.

A changed leaf makes a version of the tree: the digests of its ancestors are copied, inside its block
from the block's own levels and above it along the block's path, and every other node is shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents

#: Bits of an aligned block: 1,024 nodes.
BITS = 10
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Side of a sibling on a path; a node without one goes up alone.
LEFT, RIGHT, ALONE = "L", "R", "-"


def node(*children: str) -> str:
    """Lowercase hex SHA-256 of the children's hex texts, one after the other."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """Digest of a row: each value as ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def tree_of(column: str) -> Column:
    """Key of a partition value's tree; keys sort as the values do, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (place among the rows of the key, from 0) and ``size`` (rows of the key).

    Rows are dealt by ranges of (key, order), sorted and written; places come from the counts of each
    (range, key), so a key with a third of all rows is numbered by many tasks.
    """
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = cut(dealt.withColumns({"_part": F.spark_partition_id(), "_index": index}))
    counts = dealt.groupBy("_part", key).agg(F.min("_index").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(key)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", key, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    return dealt.join(counts, ["_part", key]).withColumn("pos", F.col("_index") + F.col("_shift")).drop("_part", "_index", "_shift")


def _levels(digests: list[str], size: int, bits: int) -> list[list[str]]:
    """Levels of one block, leaves first, of a tree with ``size`` nodes in the block's lowest level.

    A tree of one node stays as it is; a block of a larger tree goes up all ``bits`` levels, even where
    its last nodes are alone, as long as the tree has several nodes.
    """
    levels = [digests]
    while size > 1 and len(levels) <= bits:
        below = levels[-1]
        levels.append([node(*below[i : i + 2]) for i in range(0, len(below), 2)])
        size = (size + 1) // 2
    return levels


def _path(levels: list[list[str]], at: int) -> list[str]:
    """Siblings of leaf ``at`` of a block, from the lowest level up, each after its side."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append(ALONE if other >= len(level) else (LEFT if other < at else RIGHT) + level[other])
        at >>= 1
    return out


def ancestors(digest: str, path: list[str]) -> list[str]:
    """Digests of the nodes from ``digest`` to the root along a path: what a version copies."""
    out = []
    for step in path:
        side, other = step[0], step[1:]
        digest = node(other, digest) if side == LEFT else node(digest, other) if side == RIGHT else node(digest)
        out.append(digest)
    return out


def _up(nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, pos, size, digest) of the roots of the aligned blocks of ``nodes``."""

    def root(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        size, block = int(rows["size"].iloc[0]), int(rows["block"].iloc[0])
        top = _levels(list(rows["digest"]), size, bits)[-1][0]
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "pos": [block], "size": [-(-size >> bits) or 1], "digest": [top]})

    nodes = nodes.select("tree", "pos", "size", "digest", F.shiftright("pos", bits).alias("block"))
    return cut(nodes.groupBy("tree", "block").applyInPandas(root, "tree string, pos long, size long, digest string"))


def _down(nodes: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """(tree, pos, path, subroot, root) of ``nodes`` from those of the blocks above them."""

    def paths(rows: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        if rows.empty:
            return pd.DataFrame(columns=["tree", "pos", "path", "subroot", "root"])
        levels = _levels(list(rows["digest"]), int(rows["size"].iloc[0]), bits)
        rest = list(up["path"].iloc[0])
        rows["path"] = [_path(levels, i) + rest for i in range(len(rows))]
        rows["subroot"], rows["root"] = up["subroot"].iloc[0], up["root"].iloc[0]
        return rows[["tree", "pos", "path", "subroot", "root"]]

    nodes = nodes.withColumn("block", F.shiftright("pos", bits))
    both = nodes.groupBy("tree", "block").cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block"))
    return cut(both.applyInPandas(paths, "tree string, pos long, path array<string>, subroot string, root string"))


def _levels_up(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Node frames of a forest, ``nodes`` first, until each tree has one node."""
    levels = [nodes]
    while (levels[-1].agg(F.max("size")).first()[0] or 1) > 1:
        levels.append(_up(levels[-1], bits))
    return levels


def manifest(leaves: DataFrame, order: str, bits: int = BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Roots, paths and versions of a forest of Merkle trees over all rows.

    ``leaves``: tree (string), digest, changed (the digest of the tampered row, or null), the column
    ``order`` (leaves ascend by it, null first, then by digest) and the columns ``carry``. Returns one
    row per row: the columns ``carry`` and ``order``, tree, digest, subroot, root, path (siblings from
    the leaf to the root of all trees: ``L`` or ``R`` and hex, or ``-`` where a node is alone), copied
    (digests of the ancestors in the version of a changed leaf, else null), folded (root recomputed
    from the changed leaf, else from the leaf itself).
    """
    kept = list(dict.fromkeys((order, *carry)))
    places = numbered(leaves.select("tree", "digest", "changed", *kept), "tree", [order, "digest"])
    places = cut(places.withColumn("block", F.shiftright("pos", bits)))
    levels = _levels_up(places, bits)
    if len(levels) == 1:  # each tree has one row: its block is the row itself
        levels.append(_up(places, bits))
    tops = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.lit(None).cast("string").alias("changed"))
    tops = cut(numbered(tops, "tree", ["name"]))
    above = _levels_up(tops.select("tree", "pos", "size", "digest"), bits)
    top = above[-1].select("tree", "pos", F.array().cast("array<string>").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(above[:-1]):
        top = _down(nodes.select("tree", "pos", "size", "digest"), _blocks(top), bits)
    found = tops.select("pos", F.col("name"), F.col("digest").alias("own")).join(top.select("pos", "path", "root"), "pos")
    paths = found.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("own").alias("subroot"), "root")
    for nodes in reversed(levels[1:-1]):
        paths = _down(nodes, _blocks(paths), bits)
    kinds = dict(places.dtypes)
    columns = [*kept, "tree", "digest", "subroot", "root", "path", "copied", "folded"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", tree string, digest string, subroot string, root string, path array<string>, copied array<string>, folded string"

    def versions(rows: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=columns)
        rows = rows.sort_values("pos").reset_index(drop=True)
        block = _levels(list(rows["digest"]), int(rows["size"].iloc[0]), bits)
        rest = list(up["path"].iloc[0])
        rows["path"] = [_path(block, i) + rest for i in range(len(rows))]
        copied, folded = [], []
        for own, changed, path in zip(rows["digest"], rows["changed"], rows["path"], strict=True):
            new = ancestors(changed or own, path)
            copied.append(new if changed else None)
            folded.append(new[-1] if new else changed or own)
        rows["copied"], rows["folded"] = copied, folded
        rows["subroot"], rows["root"] = up["subroot"].iloc[0], up["root"].iloc[0]
        return rows[columns]

    upper = paths.select("tree", F.col("pos").alias("block"), "path", "subroot", "root")
    both = places.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block"))
    return both.applyInPandas(versions, schema)


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.select("tree", "pos", "path", "subroot", "root")


def proof(path: Column) -> Column:
    """SHA-256 of the siblings of a path, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.substring(step, 2, 64)), ""), 256)


def op11_path_copying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and tampered root of every document.

    Documents whose crc32 of the decimal id is a multiple of 7 are tampered with: n_chars grows by one
    (null stays, so such a row still verifies; a null id is never tampered with). Null values hash as
    ``-``, an empty text as ``0:``; repeated rows are leaves of their own beside each other; a table of
    one row has its leaf as root and an empty proof; an empty table gives no rows.
    """
    docs = documents(spark, sf_dir).select(*FIELDS)
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    changed = {**{c: F.col(c) for c in FIELDS}, "n_chars": more}
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select(
        "doc_id", tree_of("lang").alias("tree"), leaf(*[F.col(c) for c in FIELDS]).alias("digest"),
        F.when(tampered, leaf(*[changed[c] for c in FIELDS])).alias("changed"),
    )
    found = manifest(leaves, "doc_id")
    return found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"), F.size("path").alias("path_length"),
        F.col("copied").isNotNull().alias("tampered"), F.coalesce(F.size("copied"), F.lit(0)).alias("copied_nodes"),
    )


def walk(leaves: list[str]) -> Iterator[list[str]]:
    """Levels of one whole tree, for tests and small data."""
    yield leaves
    while len(leaves) > 1:
        leaves = [node(*leaves[i : i + 2]) for i in range(0, len(leaves), 2)]
        yield leaves


def _enc(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE concat(strlen(CAST({column} AS VARCHAR)), ':', {column}) END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(concat(" + ", ".join(_enc(n_chars if c == "n_chars" else c) for c in FIELDS) + "))"


#: The trees level by level, the siblings of each leaf, and a fold over them.
OP11_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
), d AS (
  SELECT documents.*, coalesce('=' || lang, '') AS tree,
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 7 = 0 AS hit FROM documents CROSS JOIN crc
), l AS (
  SELECT row_number() OVER () AS row, doc_id, tree, {_leaf_sql('n_chars')} AS leaf,
    CASE WHEN hit AND n_chars IS NOT NULL THEN {_leaf_sql('n_chars + 1')} END AS changed FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l
), t AS (
  SELECT tree, 0 AS lvl, pos, leaf AS h, n FROM p
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY tree, lvl, pos // 2
), s AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM s
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, pos // 2
), steps AS (
  SELECT p.row, t.lvl AS lvl, p.pos >> t.lvl AS place, x.h AS other
  FROM p JOIN (SELECT DISTINCT tree, lvl FROM t WHERE n > 1) t USING (tree) LEFT JOIN t x ON x.tree = t.tree AND x.lvl = t.lvl AND x.pos = xor(p.pos >> t.lvl, 1)
  UNION ALL
  SELECT p.row, 1000 + u.lvl, s.pos >> u.lvl, x.h
  FROM p JOIN s USING (tree) CROSS JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) u LEFT JOIN u x ON x.lvl = u.lvl AND x.pos = xor(s.pos >> u.lvl, 1)
), q AS (
  SELECT row, row_number() OVER (PARTITION BY row ORDER BY lvl) AS k, place, other FROM steps
), f AS (
  SELECT row, 0 AS k, coalesce(changed, leaf) AS h FROM p
  UNION ALL
  SELECT f.row, q.k, sha256(CASE WHEN other IS NULL THEN h WHEN place % 2 = 1 THEN other || h ELSE h || other END) FROM f JOIN q ON q.row = f.row AND q.k = f.k + 1
), g AS (
  SELECT row, arg_max(h, k) AS folded_root, max(k) AS path_length FROM f GROUP BY row
), e AS (
  SELECT row, sha256(coalesce(string_agg(other, '' ORDER BY k), '')) AS proof_sha256 FROM p LEFT JOIN q USING (row) GROUP BY row
)
SELECT doc_id, leaf, subroot, r.h AS root, proof_sha256, folded_root, folded_root = r.h AS verified, CAST(path_length AS INTEGER) AS path_length,
  changed IS NOT NULL AS tampered, CASE WHEN changed IS NULL THEN 0 ELSE CAST(path_length AS INTEGER) END AS copied_nodes
FROM p JOIN s USING (tree) JOIN g USING (row) JOIN e USING (row) CROSS JOIN (SELECT h FROM u WHERE n = 1) r
"""
