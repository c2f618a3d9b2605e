"""Floors and filters of a report's rows, as its arguments, with counts of what they drop."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floored(found: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Rows that pass all tests, with ``dropped_<name>``: how many rows fail each one first. If no row passes,
    the counts stand alone in one row."""
    why = F.coalesce(*[F.when(~F.coalesce(test, F.lit(False)), name) for name, test in tests.items()])
    marked = found.withColumn("_why", why)
    counts = marked.agg(*[F.count_if(F.col("_why") == name).alias(f"dropped_{name}") for name in tests])
    return counts.join(marked.where("_why is null").drop("_why"), F.lit(True), "left")


def options(**tests: Callable[..., Column]) -> Callable:
    """Decorator of a report: each name is an argument whose value makes a test of the report's rows.

    A value of 0, none or an empty text tests nothing. With ``counted=True`` the result also says how
    many rows each test dropped (``floored``), from the same rows.
    """

    def wrap(report: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(report)
        def run(*args, counted: bool = False, **opts) -> DataFrame:
            chosen = {name: tests[name](opts.pop(name)) for name in tests if opts.get(name)}
            found = report(*args, **{k: v for k, v in opts.items() if k not in tests})
            if counted and chosen:
                return floored(found, chosen)
            for test in chosen.values():
                found = found.where(test)
            return found

        return run

    return wrap


def least(column: str) -> Callable[..., Column]:
    return lambda value: F.col(column) >= value


def most(column: str) -> Callable[..., Column]:
    return lambda value: F.col(column) <= value


def equal(column: str) -> Callable[..., Column]:
    return lambda value: F.col(column) == value
