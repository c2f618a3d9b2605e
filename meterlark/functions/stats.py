"""Statistics that the reports share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(column: str, q: float) -> Column:
    """Nearest-rank percentile (exact)."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def linear(column: str, q: float) -> Column:
    """Percentile with linear interpolation (exact)."""
    return F.percentile(column, F.lit(q))


def ratio(a, b) -> Column:
    """a / b, 0 where b is 0 or null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def entropy(share: Column) -> Column:
    """Aggregate: bits of a distribution given as shares."""
    return F.sum(F.when(share > 0, -share * F.log2(share)).otherwise(0.0))


def gini(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, gini, n): Gini of ``value`` over the rows of each key, by ranks; 0 for one row or no sum."""
    w = Window.partitionBy(*key).orderBy(value) if key else Window.orderBy(value)
    ranked = df.withColumn("_i", F.row_number().over(w))
    n, total = F.count(F.lit(1)), F.sum(value)
    top = 2 * F.sum(F.col("_i") * F.col(value)) - (n + 1) * total
    return ranked.groupBy(*key).agg(F.when((n > 1) & (total > 0), F.greatest(F.lit(0.0), top / (n * total))).otherwise(0.0).alias("gini"))


def islands(df: DataFrame, key: list[str], order: str, same: Column) -> DataFrame:
    """``df`` with ``run``: number of the maximal run of rows (by ``order`` in a key) for which ``same``
    says that a row goes on from the row before; ``same`` may use column prev_<order>."""
    w = Window.partitionBy(*key).orderBy(order)
    marked = df.withColumn(f"prev_{order}", F.lag(order).over(w))
    marked = marked.withColumn("_new", F.when(same, 0).otherwise(1))
    return marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _ranks(df: DataFrame, value: str, key: list[str], weight: str | None = None) -> DataFrame:
    """(key, _x, n, before, all_n): per key, how many rows have each value _x, how many have smaller ones, and
    all; with ``weight`` the sums of that column instead of the numbers of rows."""
    x = F.col("_x")
    size = F.floor(F.log2(F.abs(x) + 1) * 64)
    rows = df.where(F.col(value).isNotNull()).withColumn("_x", F.col(value))
    counts = rows.groupBy(*key, "_x").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    counts = counts.withColumn("_chunk", F.when(x < 0, -size).otherwise(size))
    chunks = counts.groupBy(*key, "_chunk").agg(F.sum("n").alias("_n"))
    whole = Window.partitionBy(*key)
    order = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.select(
        *[F.col(c).alias(f"_of_{c}") for c in (*key, "_chunk")],
        F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("all_n"),
    )
    inside = Window.partitionBy(*key, "_chunk").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*key, "_chunk")]
    # Without a key there are at most some thousand chunks; with one, the sizes decide.
    met = ranked.join(starts if key else F.broadcast(starts), same)
    return met.select(*key, "_x", "n", (F.col("_start") + F.col("_inside")).alias("before"), "all_n")


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, n, before): how many rows have each value and how many have smaller ones; nulls go.

    No row goes through one task: values are counted, dealt into chunks by their
    logarithm (a few thousand for 64-bit numbers), and ranked within.
    """
    return _ranks(df, value, []).select(F.col("_x").alias(value), "n", "before")


def percentiles(
    df: DataFrame, key: list[str], value: str, names: dict[str, float], between: dict[str, float] | None = None, weight: str | None = None
) -> DataFrame:
    """(key, names, between): nearest-rank percentiles as ``nearest`` gives them and interpolated ones as
    ``linear`` does, from ranks in chunks of values; ``weight``: a column of whole numbers, each row counts so often.

    No key's values are gathered in one task. A key with null values alone has no row;
    without a key there is always one row, of nulls if no value is left.
    """
    low, high, x = F.col("before"), F.col("before") + F.col("n"), F.col("_x")
    cuts = [F.min(F.when(high >= F.col("all_n") * q, x)).cast("double").alias(name) for name, q in names.items()]
    for name, q in (between or {}).items():
        place = (F.col("all_n") - 1) * F.lit(q)
        left, right = (F.max(F.when((low <= at) & (at < high), x)) for at in (F.floor(place), F.ceil(place)))
        part = F.max(place - F.floor(place))
        cuts.append((left + part * (right - left)).cast("double").alias(name))
    return _ranks(df, value, key, weight).groupBy(*key).agg(*cuts)


def binned(df: DataFrame, group: str, value: str, edges: tuple[float, ...]) -> DataFrame:
    """Bins of ``value`` (each up to and with its edge, the last open) per group, empty ones included:
    (group, bin_index, lower, upper, count, share, cumulative_share, median, mean)."""
    index = sum((F.when(F.col(value) > e, 1).otherwise(0) for e in edges), F.lit(0))
    rows = df.select(F.col(group).alias("group"), index.alias("i"), value)
    g = rows.groupBy("group", "i").agg(F.count(F.lit(1)).alias("c"), F.avg(value).alias("avg"))
    g = g.join(percentiles(rows, ["group", "i"], value, {"med": 0.5}), ["group", "i"], "left")
    bounds = [(i, float(edges[i - 1]) if i else 0.0, float(edges[i]) if i < len(edges) else None) for i in range(len(edges) + 1)]
    bins = df.sparkSession.createDataFrame(bounds, "bin_index int, lower double, upper double")
    names = g.select("group").distinct().withColumnRenamed("group", "_g")
    full = names.crossJoin(F.broadcast(bins)).join(g, (F.col("_g") == F.col("group")) & (F.col("bin_index") == F.col("i")), "left")
    out = full.select(F.col("_g").alias("group"), "bin_index", "lower", "upper", *[F.coalesce(a, F.lit(0)).alias(b) for a, b in (("c", "count"), ("med", "median"), ("avg", "mean"))])
    w = Window.partitionBy("group")
    out = out.withColumn("share", F.col("count") / F.sum("count").over(w))
    return out.withColumn("cumulative_share", F.sum("count").over(w.orderBy("bin_index")) / F.sum("count").over(w))


def distribution(df: DataFrame, group: str, value: str, edges: tuple[float, ...]) -> DataFrame:
    """Per group: n, mean, nearest-rank percentiles, max, modal bin (lowest of equals)."""
    s = df.groupBy(F.col(group).alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("max"),
        F.stddev_samp(value).alias("stdev"),
    )
    rows = df.select(F.col(group).alias("group"), value)
    s = s.join(percentiles(rows, ["group"], value, {f"p{q}": q / 100 for q in (50, 90, 95, 99)}), "group", "left")
    modal = binned(df, group, value, edges).groupBy("group").agg((-F.max(F.struct("count", (-F.col("bin_index")).alias("i")))["i"]).alias("modal_bin_index"))
    return s.join(modal, "group")


def previous_cell(df: DataFrame, chunk: str, order: list[str], name: str = "prev") -> DataFrame:
    """Cells of time with the cell before each one as a struct, in the order (chunk, *order).

    For frames that time bounds, such as one row per hour: the window runs inside chunks (days), and the
    first cell of a chunk takes the last one of the chunk before it. Rows of a log go by ``order``.
    """
    row = F.struct(*df.columns)
    inside = Window.partitionBy(chunk).orderBy(*order)
    lasts = df.groupBy(F.col(chunk).alias("_chunk")).agg(F.max_by(row, F.struct(*order)).alias("_last"))
    lasts = lasts.select("_chunk", F.lag("_last").over(Window.orderBy("_chunk")).alias("_before"))
    out = df.withColumn("_in", F.lag(row).over(inside)).join(F.broadcast(lasts), F.col(chunk) == F.col("_chunk"))
    return out.withColumn(name, F.coalesce("_in", "_before")).drop("_in", "_before", "_chunk")
