"""One order over all rows, without one task or one group that sees them all.

``numbered`` deals rows by ranges of the order and writes them with their part and place. What goes on
from part to part (the row before, running sums, the rest of a key's rows) is computed inside parts and
carried over by a frame of one or two rows per part, so that neither a day, a user nor a session with a
third of all rows is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Bits of monotonically_increasing_id that number the rows of a partition.
_ROW_BITS = 33


def numbered(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``_part`` and ``_at``: parts follow each other in the order, as do the places in a part.

    Equal rows of the order stay in any one sequence; ``parts`` fixes the number of ranges, which
    otherwise follows the bytes.
    """
    keys = [F.col(c) for c in order]
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return written(dealt.sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": at}))


def _inside(*key: str):
    return Window.partitionBy("_part", *key).orderBy("_at")


def _by_part(frame: DataFrame, **columns: Column) -> DataFrame:
    """A frame of one row per part, with windows over it, ready to be joined: as many rows as Spark has partitions."""
    return F.broadcast(frame.select(F.col("_part").alias("_of_part"), *[c.alias(n) for n, c in columns.items()]))


def neighbour(rows: DataFrame, name: str = "prev", ahead: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Numbered ``rows`` with the row before each one (or the one after it) as a struct; null at the end."""
    row = F.struct(*(columns or [c for c in rows.columns if c not in ("_part", "_at")]))
    edge = F.min_by(row, "_at") if ahead else F.max_by(row, "_at")
    edges = rows.groupBy("_part").agg(edge.alias("_edge"))
    step = F.lead if ahead else F.lag
    carried = _by_part(edges, _carried=step("_edge").over(Window.orderBy("_part")))
    out = rows.withColumn("_near", step(row).over(_inside())).join(carried, F.col("_part") == F.col("_of_part"))
    return out.withColumn(name, F.coalesce("_near", "_carried")).drop("_near", "_carried", "_of_part")


def with_previous(df: DataFrame, *order: str, name: str = "prev", parts: int | None = None) -> DataFrame:
    """``df``, numbered in a total order, with the row before each one as a struct."""
    return neighbour(numbered(df, *order, parts=parts), name)


def running(rows: DataFrame, key: list[str], sums: dict[str, Column], firsts: dict[str, Column] | None = None) -> DataFrame:
    """Numbered ``rows`` with running values inside each ``key``, whose rows must follow each other.

    ``sums``: sums so far, the row's own included; ``firsts``: values of the key's first row. A key
    that goes over several parts takes over what its earlier parts have, from a frame of each part's
    first and last key.
    """
    firsts = firsts or {}
    rows = rows.withColumns({f"_s_{n}": c for n, c in sums.items()} | {f"_f_{n}": c for n, c in firsts.items()})
    inside = _inside(*key).rowsBetween(Window.unboundedPreceding, 0)
    local = {f"_r_{n}": F.sum(f"_s_{n}").over(inside) for n in sums} | {f"_r_{n}": F.first(f"_f_{n}").over(inside) for n in firsts}
    whole = rows.groupBy("_part", *key).agg(
        F.min("_at").alias("_low"), *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums], *[F.min_by(f"_f_{n}", "_at").alias(f"_f_{n}") for n in firsts]
    )
    ends = rows.groupBy("_part").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    lasts = whole.groupBy("_part").agg(F.max("_low").alias("_last_low"))
    ends = _by_part(ends.join(lasts, "_part"), _first=F.col("_first"), _last_low=F.col("_last_low"))
    edges = whole.join(ends, F.col("_part") == F.col("_of_part")).where("_low = _first or _low = _last_low")
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if key else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select(
        F.col("_part").alias("_of_part"), F.col("_low").alias("_of_low"), F.count(F.lit(1)).over(before).alias("_earlier"),
        *[F.sum(f"_s_{n}").over(before).alias(f"_c_{n}") for n in sums], *[F.first(f"_f_{n}").over(before).alias(f"_c_{n}") for n in firsts],
    )
    # A part's first key is the only one that may go on from an earlier part.
    carry = F.broadcast(carry.where("_earlier > 0"))
    starts = rows.withColumns(local | {"_low": F.min("_at").over(_inside(*key).rowsBetween(Window.unboundedPreceding, 0))})
    out = starts.join(carry, (F.col("_part") == F.col("_of_part")) & (F.col("_low") == F.col("_of_low")), "left")
    values = {n: F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.col(f"_r_{n}") for n in sums}
    values |= {n: F.when(F.col("_earlier") > 0, F.col(f"_c_{n}")).otherwise(F.col(f"_r_{n}")) for n in firsts}
    gone = [c for c in out.columns if c.startswith(("_s_", "_f_", "_r_", "_c_", "_of_"))] + ["_low", "_earlier"]
    return out.withColumns(values).drop(*gone)
