"""How queries are registered: name, columns, job, SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .prelude import oracle

#: Day of the reports that look back from a time (2024-01-31), in days since 1970.
AS_OF = 19753
_KINDS = {"e": "double", "g": "double", "i": "bigint", "f": "double", "s": "string", "b": "boolean"}


@dataclass(frozen=True)
class Query:
    """``columns``: name:kind, kinds i(nteger), f(loat, 6 decimals), e (8 decimals), g (3 decimals), s(tring), b(oolean)."""

    name: str
    columns: str
    job: Callable[[SparkSession, str], DataFrame]
    body: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df, out = self.job(spark, sf_dir), []
        for column, kind in (c.split(":") for c in self.columns.split()):
            value = F.col(column).cast(_KINDS[kind])
            digits = {"f": 6, "e": 8, "g": 3}.get(kind)
            out.append((F.round(value, digits) if digits else value).alias(column))
        return df.select(*out)

    @property
    def sql(self) -> str | None:
        return oracle(self.columns, self.body) if self.body else None


#: A window and a source, whose dropped rows the ``_counted`` reports count.
COUNTED = {"since": "2024-01-05T00:00:00Z", "source": "click"}
#: v: the rows left; c0: how many were dropped, and why.
COUNTED_SQL = """
w0 AS (SELECT * FROM su WHERE t >= TIMESTAMP '2024-01-05'), v AS (SELECT * FROM w0 WHERE total > 0 AND source = 'click'),
c0 AS (SELECT 0 AS dropped_invalid_hour_start, count(*) FILTER (total <= 0) AS dropped_zero_tokens, count(*) FILTER (total > 0 AND source <> 'click') AS dropped_source_filter, 0 AS dropped_model_filter FROM w0)"""
COUNTED_COLUMNS = " dropped_invalid_hour_start:i dropped_zero_tokens:i dropped_source_filter:i dropped_model_filter:i "
