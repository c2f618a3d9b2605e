"""All queries over the logs."""

from __future__ import annotations

from . import cyclic, distribution, files, options, sequence, series, tenure, totals

ALL = [*totals.QUERIES, *cyclic.QUERIES, *distribution.QUERIES, *tenure.QUERIES, *series.QUERIES, *sequence.QUERIES, *files.QUERIES, *options.QUERIES]
QUERIES = {q.name: q.run for q in ALL}
ORACLE_SQL = {q.name: q.sql for q in ALL if q.sql}
