"""Column functions over bound maps and node flags.

Bound overrides are sparse ``MAP<STRING, DOUBLE>`` columns: a missing key means
"no override", so merging keeps the stricter value and adds missing keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica import schemas


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def merge_upper(old: Column | str, new: Column | str) -> Column:
    """Upper-bound maps merged key by key, keeping the smaller (stricter) value.

    ``least`` skips nulls, so a key present on one side only keeps that value.
    """
    return F.map_zip_with(_col(old), _col(new), lambda _k, x, y: F.least(x, y))


def merge_lower(old: Column | str, new: Column | str) -> Column:
    """Lower-bound maps merged key by key, keeping the greater (stricter) value."""
    return F.map_zip_with(_col(old), _col(new), lambda _k, x, y: F.greatest(x, y))


def bounds_changed(old: Column | str, merged: Column | str) -> Column:
    """True when ``merged`` differs from ``old`` in some entry (Spark cannot
    compare maps directly, so entries are compared null-safely)."""
    o = _col(old)
    return F.exists(F.map_entries(_col(merged)),
                    lambda e: ~e["value"].eqNullSafe(F.try_element_at(o, e["key"])))


def tighten_lower(base: Column | str, override: Column) -> Column:
    """Base lower bound tightened by an optional override (null = none)."""
    return F.greatest(_col(base), override)


def tighten_upper(base: Column | str, override: Column) -> Column:
    return F.least(_col(base), override)


def is_subtree_root(depth: Column | str = "depth", subtree_root_depth: Column | str = "subtree_root_depth") -> Column:
    """A node is the root of its subtree when no root depth is known yet or it is
    not deeper than the recorded root depth."""
    d, r = _col(depth), _col(subtree_root_depth)
    return r.isNull() | (d <= r)


def status_of(feasible: Column | str, optimal: Column | str,
              unbounded: Column | str | None = None, error: Column | str | None = None) -> Column:
    """Fold the five solver flags into one status string.

    Precedence: error, unbounded, optimal, feasible, otherwise infeasible.
    """
    out = F.when(_col(optimal), F.lit(schemas.OPTIMAL)).when(_col(feasible), F.lit(schemas.FEASIBLE)) \
        .otherwise(F.lit(schemas.INFEASIBLE))
    if unbounded is not None:
        out = F.when(_col(unbounded), F.lit(schemas.UNBOUNDED)).otherwise(out)
    if error is not None:
        out = F.when(_col(error), F.lit(schemas.ERROR)).otherwise(out)
    return out


def is_feasible_or_optimal(status: Column | str = "status") -> Column:
    return _col(status).isin(schemas.FEASIBLE, schemas.OPTIMAL)


def is_completed(status: Column | str = "status") -> Column:
    """Completed subtree/node: solved or proven impossible, or aborted (F1).
    Infeasible and unbounded are terminal here too (the reference kept them, D4)."""
    return _col(status).isin(schemas.ERROR, schemas.OPTIMAL, schemas.INFEASIBLE,
                             schemas.UNBOUNDED, schemas.ABORTED)
