"""Packing token sequences by Karmarkar-Karp differencing.

A document's ids fill whole windows as far as they go; what is left is cut into pieces
of at most ``piece`` ids. Pieces are dealt at random into groups of a fixed mean size
and each group's windows are made by multiway differencing: pieces, largest first, in
partial partitions of one piece per window, and partial partitions with the largest
differences are merged with opposing imbalances, the fullest window of one with the
emptiest of the other. If a window exceeds the capacity, the group gets more windows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import KNOWN, library_table, slices
from .common import cut, documents, text_or_empty

CAPACITY, PIECE, WINDOWS = 1024, 256, 1024


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size, sums near equal."""
    order = np.argsort(-sizes, kind="stable")
    partials: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    window_of = np.zeros(len(sizes), np.int64)
    groups: list[np.ndarray] = []
    for at in range(0, len(order), windows):
        held = np.full(windows, -1, np.int64)
        part = order[at : at + windows]
        held[: len(part)] = part
        sums = np.zeros(windows, np.int64)
        sums[: len(part)] = sizes[part]
        groups.append(held[:, None])
        partials.append((-int(sums[0] - sums[-1]), len(groups) - 1, sums, held[:, None]))
    heapq.heapify(partials)
    serial = len(groups)
    while len(partials) > 1:
        _, _, a, x = heapq.heappop(partials)
        _, _, b, y = heapq.heappop(partials)
        down, up = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
        sums, held = a[down] + b[up], np.concatenate([x[down], y[up]], axis=1)
        serial += 1
        heapq.heappush(partials, (-int(sums.max() - sums.min()), serial, sums, held))
    if partials:
        held = partials[0][3]
        rows, columns = np.nonzero(held >= 0)
        window_of[held[rows, columns]] = rows
    return window_of


def windows_for(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size, none over the capacity; as few windows as the method gives."""
    n = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        of = differencing(sizes, n)
        if np.bincount(of, sizes, minlength=n).max(initial=0) <= capacity:
            return of
        n += max(1, n // 500)


def _cuts(n: int, capacity: int, piece: int) -> list[int]:
    """Ends of the pieces of n ids: whole windows, then near-equal pieces of what is left."""
    full, left = divmod(n, capacity)
    parts = -(-left // piece)
    return [capacity * (i + 1) for i in range(full)] + [capacity * full + left * (i + 1) // parts for i in range(parts)]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, piece: int = PIECE, keep_ids: bool = True, known: int = KNOWN) -> DataFrame:
    """Pieces of each row's ids and an end id: (id_col, row, start, length, ids_crc32, doc_tokens[, ids]).
    A worker remembers some ``known`` chunks; fewer take less memory and more time."""
    names = ["i", "row", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = library_table(vocabulary, known)
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for part in slices(texts, [len(t) for t in texts], min(8 << 20, 10 * known)):
                out: list[list] = [[] for _ in range(7)]
                for k, ids in enumerate(table.ids(texts[part]), part.start):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    start = 0
                    for end in _cuts(len(ids), capacity, piece):
                        own = ids[start:end]
                        for column, x in zip(out, (k, start, end - start, zlib.crc32(own.tobytes()), len(ids)), strict=False):
                            column.append(x)
                        if keep_ids:
                            out[5].append(own.view("<i4"))
                        start = end
                where = pa.array(out[0], pa.int64())
                columns = [batch.column("i").take(where), batch.column("row").take(where), *[pa.array(c, pa.int64()) for c in out[1:5]]]
                if keep_ids:
                    columns.append(pa.array(out[5], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * keep_ids)

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("t"))
    schema = ", ".join(f"{n} long" for n in names) + ", ids array<int>" * keep_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("i", id_col)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = True, windows: int = WINDOWS, known: int = KNOWN) -> DataFrame:
    """Pieces with their places: + sequence_id, offset (gapless from 0 in each sequence).

    Every id of every row lies in one piece and no sequence exceeds the capacity. Null and
    empty texts give the end id alone. Repeated rows are packed each. An empty table
    gives no rows; other columns are ignored.
    """
    every = cut(pieces(docs, vocabulary, id_col, text_col, capacity=capacity, keep_ids=keep_ids, known=known))
    whole = every.where(F.col("length") == capacity).withColumn("sequence_id", 2 * F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = every.where(F.col("length") < capacity)
    total = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (capacity * windows)))
    # A group is a random share of the pieces; its mean size is fixed, whatever the input.
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("row", "start"), F.lit(groups)))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "start"], ignore_index=True)
        of = windows_for(frame["length"].to_numpy(np.int64), capacity)
        frame = frame.assign(sequence_id=of).sort_values(["sequence_id", "row", "start"], ignore_index=True)
        frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
        frame["sequence_id"] = (frame["group"] * (1 << 24) + frame["sequence_id"]) * 2 + 1
        return frame[["row", "start", "sequence_id", "offset"]]

    slim = dealt.select("group", "row", "start", "length")
    placed = slim.groupBy("group").applyInPandas(place, "row long, start long, sequence_id long, offset long")
    out = whole.unionByName(rest.join(placed, ["row", "start"]).select(*whole.columns))
    return out.drop("row")


def op7_differencing_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
