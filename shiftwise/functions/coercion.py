"""Text columns coerced to times, and counts of what coercion loses.

A column of date text is read by one format. Which one is found by a single
aggregate over the column: how many values each candidate reads; the format that reads
most wins, the earlier candidate among equals. Values that it does not read become
missing, as they do when a frame's column is coerced by the format of its first value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shiftwise.functions.exprs import ntz_lit

# Date formats that a column may be written in, in order of
# preference (month before day where both fit).
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy-M-d H:m:s",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d H:m:s.SSSSSS",
    "yyyy-M-d H:m",
    "yyyy/M/d",
    "M/d/yyyy",
    "M/d/yyyy H:m:s",
    "M/d/yyyy H:m",
    "d/M/yyyy",
    "d/M/yyyy H:m:s",
    "d/M/yyyy H:m",
    "d.M.yyyy",
    "d-M-yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMMM d yyyy",
    "yyyyMMdd",
)


def read_time(text: Column | str, pattern: str | None) -> Column:
    """TIMESTAMP_NTZ that ``text`` writes in ``pattern``, else null. The text is read as
    of no zone, so no clock change of the session's zone can move it."""
    c = F.col(text) if isinstance(text, str) else text
    if pattern is None:
        return F.lit(None).cast("timestamp_ntz")
    instant = F.try_to_timestamp(F.concat(F.trim(c), F.lit(" +0000")), F.lit(f"{pattern} xx"))
    seconds = (F.unix_micros(instant).cast("decimal(24,6)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return ntz_lit("1970-01-01") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def infer_format(df: DataFrame, column: str, formats: tuple[str, ...] = DATE_FORMATS) -> str | None:
    """The format that reads most values of ``column``; None if no one reads any.
    One pass; a number for each candidate comes to the driver."""
    counts = df.agg(*[F.count(read_time(column, f)).alias(f"n{i}") for i, f in enumerate(formats)]).first()
    most = max(counts)
    return formats[list(counts).index(most)] if most else None


def coerce_dates(df: DataFrame, *columns: str, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """``df`` with each text column of ``columns`` as TIMESTAMP_NTZ, read by the
    column's own format."""
    return df.withColumns({c: read_time(c, infer_format(df, c, formats)) for c in columns})


def observe_losses(df: DataFrame, coerced: dict[str, tuple[Column, Column]], losses: Observation) -> DataFrame:
    """``df``, counting on its way the values lost to coercion: for each name of
    ``coerced``, rows whose raw value is there and whose coerced value is not. The
    counts are in ``losses.get`` once an action has run over the result; no second pass is made."""
    lost = [F.count_if(raw.isNotNull() & value.isNull()).alias(name) for name, (raw, value) in coerced.items()]
    return df.observe(losses, *lost)
