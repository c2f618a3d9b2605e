"""Reports with their floors and filters, and how many rows each of these drops."""

from __future__ import annotations

from ..operators import cyclic as c
from ..operators import distribution as d
from ..operators import series as s
from ..operators import tenure as t
from ..sources import adapter
from . import cyclic, distribution, series, tenure
from .registry import Query
from .series import rare

_BASE = {q.name: q for plan in (cyclic, distribution, series, tenure) for q in plan.QUERIES}
usage, sparse = adapter.usage, cyclic.sparse


def _with(report, rows, values: dict, conditions: dict[str, str]) -> Query:
    """``conditions``: the SQL that each option of ``values`` asks of a row."""
    base = _BASE[report.__name__]
    head, _, tail = base.body.rpartition("out AS (")
    why = "CASE " + " ".join(f"WHEN NOT coalesce({test}, false) THEN '{name}'" for name, test in conditions.items()) + " ELSE '' END AS why"
    counts = ", ".join(f"count(*) FILTER (why = '{name}') AS dropped_{name}" for name in values)
    body = f"""{head}every AS ({tail}, marked AS (SELECT *, {why} FROM every),
out AS (SELECT * FROM (SELECT {counts} FROM marked) LEFT JOIN (SELECT * FROM marked WHERE why = '') ON true)"""
    columns = base.columns + "".join(f" dropped_{name}:i" for name in values)
    return Query(f"{base.name}_options", columns, lambda spark, sf: report(rows(spark, sf), counted=True, **values), body)


QUERIES = [
    _with(c.hour_of_week, usage, {"min_cell_tokens": 60_000}, {"min_cell_tokens": "tokens >= 60000"}),
    _with(c.source_hour_centroid, sparse, {"max_spread": 5.5, "min_r": 0.2}, {"max_spread": "spread_hours <= 5.5", "min_r": "resultant_length >= 0.2"}),
    _with(c.source_hod_topk_share, sparse, {"min_share": 0.3}, {"min_share": "top_k_share >= 0.3"}),
    _with(c.source_dead_hours, sparse, {"min_dead_hours": 6, "min_longest_run": 2}, {"min_dead_hours": "dead_hours >= 6", "min_longest_run": "longest_dead_run >= 2"}),
    _with(c.source_active_hour_longest_run, sparse, {"min_longest_run": 4, "min_active_hours": 19}, {"min_longest_run": "longest_active_run >= 4", "min_active_hours": "active_hours >= 19"}),
    _with(c.source_active_hour_span, sparse, {"max_span": 23, "min_largest_quiet_gap": 2}, {"max_span": "circular_span <= 23", "min_largest_quiet_gap": "largest_quiet_gap >= 2"}),
    _with(c.source_hod_entropy, sparse, {"min_normalized": 0.9, "min_effective_hours": 15}, {"min_normalized": "entropy_normalized >= 0.9", "min_effective_hours": "effective_hours >= 15"}),
    _with(d.source_benford, usage, {"require_mode": 1}, {"require_mode": "mode_digit = 1"}),
    _with(t.tenure_density_quadrant, usage, {"quadrant": "long-dense"}, {"quadrant": "quadrant = 'long-dense'"}),
    _with(s.source_active_day_streak, rare, {"min_longest_streak": 3}, {"min_longest_streak": "longest_streak >= 3"}),
    _with(s.source_dry_spell, rare, {"min_longest": 3, "min_fraction": 0.4}, {"min_longest": "longest_dry_spell >= 3", "min_fraction": "dry_spell_fraction >= 0.4"}),
    _with(s.daily_zscore_extremes, rare, {"min_extreme": 1, "direction": "high"}, {"min_extreme": "n_extreme >= 1", "direction": "max_abs_z_direction = 'high'"}),
    _with(s.daily_monotone_runs, rare, {"min_longest_run": 4, "direction": "up"}, {"min_longest_run": "longest_monotone_run >= 4", "direction": "longest_direction = 'up'"}),
    _with(s.daily_second_diff_runs, rare, {"min_current_run": 2}, {"min_current_run": "current_run_length >= 2"}),
]
