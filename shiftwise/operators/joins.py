"""Join shapes that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_skew_safe(left: DataFrame, right: DataFrame, keys: list[str], one_key: bool = False) -> DataFrame:
    """``left LEFT JOIN right USING (keys)`` that tolerates a hot key in ``right``.

    A left outer join can only split skew on its preserved (left) side, so a
    key holding a third of ``right`` would land in one task. The same result
    is built from an inner join (AQE splits either side) plus the left rows
    whose key has no partner, found by an anti join against the *distinct*
    keys of ``right`` (deduplicated map-side, so the hot key is one row).
    Null keys never match, as in the outer join.
    """
    if one_key:  # both sides are already cut to a single key
        return left.join(right, keys, "left")
    matched = left.join(right, keys, "inner")
    right_keys = right.select(*keys).distinct()
    unmatched = left.join(right_keys, keys, "left_anti")
    right_only = [c for c in right.columns if c not in keys]
    dtypes = dict(right.dtypes)
    padded = unmatched.select(
        *unmatched.columns, *[F.lit(None).cast(dtypes[c]).alias(c) for c in right_only]
    )
    return matched.unionByName(padded)


# Largest row count broadcast on the strength of a bound known before running.
BROADCAST_ROW_LIMIT = 1_000_000


def bounded_broadcast(df: DataFrame, row_bound: int, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast of ``df`` when ``row_bound`` (a proven upper bound on
    its rows, e.g. hours in a requested range) is at most ``limit``;
    otherwise leave the choice to Spark's size-based planning."""
    return F.broadcast(df) if 0 <= row_bound <= limit else df
