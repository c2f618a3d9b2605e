"""Exact top-k inner products over norm-sorted blocks.

Vectors are dealt into bands and blocks by descending length. A first pass scores every
query against the longest vectors, which gives it a floor for its k-th score. By Cauchy and
Schwarz a query can't reach its floor in bands whose vectors are shorter than floor / query
length: queries of like reach form parts, and only the (part, block) pairs within reach are
exchanged. Inside a pair, vectors are taken by descending length and rotated by the singular
vectors of a sample; the first coordinates are multiplied, the rest bounded by the lengths of
what is left, and only columns that some query may still want are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors of a block, queries of a part, and how much below a bound counts as below (rotation is inexact).
BLOCK, QUERIES, SLACK = 8192, 16384, 1e-6
#: Bands of lengths, and numbers in the sample that the rotation is fitted on (any rotation gives right results).
BANDS, SAMPLE = 1024, 1 << 22


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v array<double>): floor(scale * x) of the rows without nulls or non-finite numbers."""

    def down(e):
        x = F.lit(scale) * e.cast("double")
        # Doubles of 2^53 and more are whole; floor() would take them through a long.
        return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)

    fine = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(vector_col, down).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    lists = list(column)
    if lists and all(len(x) == width for x in lists):
        return np.stack(lists)
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of a sample by hash of at most SAMPLE numbers."""
    rows = vectors.orderBy(F.xxhash64("id")).limit(max(2, SAMPLE // width)).select("v").toPandas()["v"]
    m = _matrix(rows, width)
    values, basis = np.linalg.eigh(m.T @ m)
    return basis[:, np.argsort(-values)]


def _best(q: np.ndarray, qids: np.ndarray, x: np.ndarray, xids: np.ndarray, k: int, floors: np.ndarray, rotation: np.ndarray, head: int, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec, score) of the k best of ``x`` for each query, left out where below its floor.
    ``seen`` counts the products: all, within the length bound, and scored."""
    order = np.lexsort((xids, -np.einsum("ij,ij->i", x, x)))
    x, xids = x[order], xids[order]
    qr, xr = q @ rotation, x @ rotation
    q_rest, x_rest = (np.sqrt(np.maximum(0, (m[:, head:] ** 2).sum(axis=1))) for m in (qr, xr))
    q_norm, x_norm = np.sqrt((q**2).sum(axis=1)), np.sqrt((x**2).sum(axis=1))
    exact = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])) < 2**53
    floors = floors.copy()
    most, at, step = int(min(512, max(64, (1 << 21) // max(1, len(q))))), 0, max(k, 32)
    rows, scores, ids = np.empty(0, np.int64), np.empty(0, float if exact else object), np.empty(0, np.int64)
    while at < len(x):
        # The first steps are small, since the floors rise most there.
        end = min(len(x), at + step)
        part, own, here = x[at:end], xids[at:end], slice(at, end)
        open_ = np.flatnonzero(q_norm * x_norm[at] * (1 + SLACK) + SLACK >= floors)
        if not len(open_):
            break  # later vectors are no longer
        norms = np.outer(q_norm[open_], x_norm[here])
        may = qr[open_, :head] @ xr[here, :head].T + np.outer(q_rest[open_], x_rest[here]) + SLACK * (1 + norms) >= floors[open_][:, None]
        may &= own[None, :] != qids[open_][:, None]
        at, step = end, min(most, 2 * step)
        columns = np.flatnonzero(may.any(axis=0))
        wanted = np.flatnonzero(may.any(axis=1))
        if seen is not None:
            seen["within"] = seen.get("within", 0) + may.size
            seen["scored"] = seen.get("scored", 0) + len(columns) * len(wanted)
        if not len(columns):
            continue
        a, b = q[open_[wanted]], part[columns]
        found = a @ b.T if exact else a.astype(object) @ b.T.astype(object)
        i, j = np.nonzero(may[np.ix_(wanted, columns)] & (found >= floors[open_[wanted]][:, None]))
        rows = np.concatenate([rows, open_[wanted[i]]])
        scores, ids = np.concatenate([scores, found[i, j]]), np.concatenate([ids, own[columns[j]]])
        # The k best of each query stay; its floor is the last of them.
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        nth = np.arange(len(rows)) - np.repeat(starts, np.diff(starts, append=len(rows)))
        full = nth == k - 1
        floors[rows[full]] = np.maximum(floors[rows[full]], scores[full].astype(float))
        rows, scores, ids = rows[nth < k], scores[nth < k], ids[nth < k]
    return qids[rows], ids, scores.astype(np.int64)


def _shares(counts: dict[int, int], size: int) -> tuple[dict[int, int], dict[int, int], int]:
    """Groups of about ``size`` for classes in this order: (first group of each class, its groups, all groups)."""
    first, shares, groups, held = {}, {}, 0, 0
    for c, n in counts.items():
        if groups and held + n <= size:
            first[c], shares[c] = groups - 1, 1
            held += n
        else:
            first[c], shares[c] = groups, -(-n // size)
            groups += shares[c]
            held = n if shares[c] == 1 else size
    return first, shares, groups


def _dealt(kind: str, id_col: str, first: dict[int, int], shares: dict[int, int]):
    """A Column: the group of a row by its class and the hash of its id."""
    of = F.create_map(*[F.lit(x) for c in first for x in (c, first[c])])
    many = F.create_map(*[F.lit(x) for c in first for x in (c, shares[c])])
    return of[F.col(kind)] + F.pmod(F.xxhash64(id_col), many[F.col(kind)]).cast("int")


def within_reach(asked: DataFrame, rows: DataFrame, top: float, first: dict[int, int], shares: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """Queries (qid, qv, floor) and vectors (cid, cv) by part and block, only for pairs that the length bound leaves.

    A query reaches the bands whose longest vector may meet its floor: a run from band 0 on.
    Parts hold queries of like reach, farthest first, so a band meets a run of parts from
    part 0 on. Block 0 is not dealt again.
    """
    low = F.col("floor") * (1 - SLACK) - SLACK
    furthest = F.floor(BANDS * (1 - low / (F.col("qnorm") * top * (1 + SLACK)))).cast("int") + 1
    reach = F.when(F.col("floor").isNull() | (low <= 0) | (F.col("qnorm") == 0), F.lit(BANDS - 1)).otherwise(F.least(F.lit(BANDS - 1), F.greatest(F.lit(0), furthest)))
    asked = cut(asked.withColumn("reach", reach))
    counts = {r["reach"]: r["count"] for r in asked.groupBy("reach").count().collect()}  # at most BANDS rows
    part_first, part_shares, parts = _shares({c: counts[c] for c in sorted(counts, reverse=True)}, QUERIES)
    met, last = [0] * BANDS, [0] * BANDS
    for c, f in part_first.items():
        for b in range(c + 1):
            met[b] = max(met[b], f + part_shares[c])
    for b in range(BANDS):
        last[b] = max(last[b - 1] if b else 0, first[b] + shares[b] - 1 if b in first else 0)

    def of(values: list[int], band: str):
        return F.element_at(F.array(*map(F.lit, values)), F.col(band) + 1)

    until = of(last, "reach")
    blocks = F.when(until >= 1, F.sequence(F.lit(1), F.greatest(until, F.lit(1))))
    left = asked.select(_dealt("reach", "id", part_first, part_shares).alias("part"), F.col("id").alias("qid"), F.col("v").alias("qv"), "floor", F.explode(blocks).alias("block"))
    count = of(met, "band")
    some = F.when(count >= 1, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))))
    right = rows.where("block > 0").select("block", F.col("id").alias("cid"), F.col("v").alias("cv"), F.explode(some).alias("part"))
    return left, right


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, head: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` largest inner products of each query.

    ``vectors`` and ``queries`` are (id, v array<double>) of whole numbers; other columns are
    ignored. A query's own id is left out, on every row that has it. Ties go to the smaller
    id. Vectors of different lengths end in zeros. A repeated row is a candidate of its own;
    repeated queries give one result. Null ids take no part. No vectors or no queries give
    no rows. A score beyond a long is an error.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))
    vectors = cut(vectors.where("id is not null").select("id", "v", norm.alias("norm")))
    width, top = vectors.agg(F.max(F.size("v")), F.max("norm")).first()
    if not width:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rotation = _rotation(vectors, width)

    # Bands of lengths, longest first; a band of n vectors is dealt over ceil(n / BLOCK) blocks by id.
    top = max(top, 1e-300)
    band = F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), F.floor((1 - F.col("norm") / top) * BANDS).cast("int")))
    sized = vectors.withColumn("band", band)
    counts = {r["band"]: r["count"] for r in sized.groupBy("band").count().collect()}  # at most BANDS rows
    first, shares, blocks = _shares({b: counts[b] for b in sorted(counts)}, BLOCK)
    rows = sized.select("id", "v", "band", _dealt("band", "id", first, shares).alias("block"))
    asked = queries.where("id is not null").dropDuplicates(["id"]).select("id", "v", norm.alias("qnorm"))
    asked = cut(asked)

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        floors = left["floor"].to_numpy(dtype=float)
        found = _best(_matrix(left["qv"], width), left["qid"].to_numpy(), _matrix(right["cv"], width), right["cid"].to_numpy(), k, np.where(np.isnan(floors), -np.inf, floors), rotation, min(head, width))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    def run(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(score, "query_id long, vec_id long, score long")

    n = max(1, -(-asked.count() // QUERIES))
    lead = asked.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("part"), F.lit(0).alias("block"), F.col("id").alias("qid"), F.col("v").alias("qv"), F.lit(None).cast("double").alias("floor"))
    longest = rows.where("block = 0").select("block", F.col("id").alias("cid"), F.col("v").alias("cv"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"))
    found = cut(run(lead, longest))
    if blocks > 1:
        floors = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor"))
        floored = asked.join(floors, F.col("id") == F.col("query_id"), "left").select("id", "v", "qnorm", "floor")
        found = found.unionByName(run(*within_reach(floored, rows, top, first, shares)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_norm_sorted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for each whose id is divisible by 20; nulls, ties, repeated
    rows and empty tables as in ``top_k``."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 64.0)
    return top_k(vectors, vectors.where("id % 20 = 0"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
