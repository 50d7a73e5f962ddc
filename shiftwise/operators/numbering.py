"""Row numbers within groups that do not put a whole group in one task.

``row_number() OVER (PARTITION BY keys ORDER BY ...)`` sorts every group
inside a single task, so one group holding a third of the rows becomes one
task holding a third of the data. Instead the caller names *slices*: columns
computed from the row whose order agrees with the wanted one (say the hour of
a time that is sorted first). Then

1. rows are numbered inside their (group, slice);
2. rows are counted per (group, slice), a small table, and the counts of the
   slices before are added up (a window over at most as many rows as the group
   has slices);
3. that offset is added to the number inside the slice.

A slice depends on nothing but its row, so the plan is lazy and a recomputed
task gives the same numbers. Rows that tie on the whole order may be numbered
either way, as with ``row_number``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwise.sources.shared import write_shared

_PLACE_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def number_within(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    slices: list[Column],
    out: str = "row_no",
    counts: DataFrame | None = None,
) -> DataFrame:
    """``df`` plus ``out`` = 1-based row number per ``keys`` group in ``order``.

    ``order`` are sort expressions (e.g. ``F.col("t").asc_nulls_last()``);
    ``slices`` ascend with the order; ``keys`` may be empty for one global
    numbering. ``counts``, where the caller has a cheaper way to them than counting
    ``df``, are the rows ``_n`` per keys and slices (``_slice0``, ``_slice1`` ...).
    """
    names = [f"_slice{i}" for i in range(len(slices))]
    sliced = df.select("*", *[c.alias(n) for c, n in zip(slices, names)])
    within = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order))
    if counts is None:
        counts = sliced.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_k{c}") for c in [*keys, *names]], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    numbered = sliced.withColumn("_within", within)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in [*keys, *names]])
    number = (F.col("_before") + F.col("_within")).cast("long")
    return numbered.join(offsets, same).select(*df.columns, number.alias(out))


def number_by_range(df: DataFrame, order: list[Column], out: str = "row_no") -> DataFrame:
    """``df`` plus ``out`` = 1-based number of each row in one global ``order``.

    Rows are dealt by sampled ranges of the whole order, sorted inside each
    range and written to the shared folder with their place; a range's offset
    is the number of rows in the ranges before it (one row per range). No
    common prefix or slice of the order gathers in one task, and the stored
    places stay the same when a task is run again. Rows that tie on the whole
    order share a range; end ``order`` with a unique column to spread them.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = write_shared(placed, "numbered")
    part = F.shiftright("_at", _PLACE_BITS)
    counts = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # one row per range
    place = F.col("_at") - F.shiftleft(part, _PLACE_BITS)
    number = (F.col("_before") + place + 1).cast("long")
    return stored.join(F.broadcast(offsets), part == F.col("_part")).select(*df.columns, number.alias(out))
