"""The order over all rows: the row before, running values and carries, against plain lists."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meterlark.functions import order, stats


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    # One key has more than a third of the rows, so it goes over several parts.
    return sorted({(r.choice([7, 7, 7, *range(20)]), r.randrange(400), r.randrange(5)) for _ in range(2000)})


def frame(spark, rows):
    r = random.Random(4)
    return spark.createDataFrame(r.sample(rows, len(rows)), "k long, t long, x long")


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_previous_and_next(spark, rows, parts):
    o = order.numbered(frame(spark, rows), "k", "t", "x", parts=parts)
    both = order.neighbour(order.neighbour(o), "next", ahead=True, columns=["k", "t", "x"])
    got = sorted(((r.k, r.t, r.x), r.prev and tuple(r.prev), r.next and tuple(r.next)) for r in both.collect())
    assert got == [(x, rows[i - 1] if i else None, rows[i + 1] if i + 1 < len(rows) else None) for i, x in enumerate(rows)]
    sizes = [r["count"] for r in o.groupBy("_part").count().collect()]
    assert max(sizes) <= 2.5 * len(rows) / parts


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_running_values_go_on_over_parts(spark, rows, parts):
    o = order.numbered(frame(spark, rows), "k", "t", "x", parts=parts)
    got = order.running(o, ["k"], {"so_far": F.col("x"), "n": F.lit(1)}, {"start": F.col("t")})
    want, seen = [], {}
    for k, t, x in rows:
        s, n, start = seen.get(k, (0, 0, t))
        seen[k] = (s + x, n + 1, start)
        want.append((k, t, x, *seen[k]))
    assert sorted((r.k, r.t, r.x, r.so_far, r.n, r.start) for r in got.collect()) == want
    everything = order.running(o, [], {"n": F.lit(1)})
    assert sorted(r.n for r in everything.collect()) == list(range(1, len(rows) + 1))


def test_nulls_and_no_rows(spark):
    o = order.numbered(spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k long, t long"), "k", "t", parts=3)
    assert sorted((r.t, r.n) for r in order.running(o, ["k"], {"n": F.lit(1)}, {"a": F.col("t")}).collect()) == [(1, 1), (2, 2), (3, 1)]
    empty = order.numbered(spark.createDataFrame([], "k long"), "k")
    assert order.neighbour(empty).count() == 0 and order.running(empty, ["k"], {"n": F.lit(1)}).count() == 0


def test_quantiles_are_those_of_the_values(spark, rows):
    df = frame(spark, rows)
    got = {r.k: r for r in stats.percentiles(df, ["k"], "t", {"n90": 0.9}, {"m": 0.5, "l": 0.33}).collect()}
    want = df.groupBy("k").agg(stats.nearest("t", 0.9).alias("n90"), stats.linear("t", 0.5).alias("m"), stats.linear("t", 0.33).alias("l")).collect()
    assert len(got) == len(want) and all(abs(got[r.k][c] - r[c]) < 1e-9 for r in want for c in ("n90", "m", "l"))
    weighted = stats.percentiles(spark.createDataFrame([(1, 94), (2, 1), (3, 5)], "v long, w long"), [], "v", {"p": 0.95}, weight="w")
    assert weighted.first()["p"] == 2
