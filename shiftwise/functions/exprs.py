"""Column expressions shared by the reports.

All of them are built-in Spark expressions (whole-stage codegen, no Python
per row). Time arithmetic works on TIMESTAMP_NTZ and never depends on the
session time zone. Money and durations are rounded in DECIMAL, half away
from zero, so ties round the way a database NUMERIC does.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_MINUTE = 60 * MICROS_PER_SECOND
MICROS_PER_HOUR = 60 * MICROS_PER_MINUTE

# Money column type: stored values are text; two decimals in practice. Ten
# decimals and eighteen digits before them are kept; more fail the job.
MONEY = "decimal(28,10)"
# Value already rounded to two places (hours, minutes, money).
ROUNDED = "decimal(20,2)"
# Integer operand of an exact division (counts, micros).
WHOLE = "decimal(20,0)"
# Operand of a percentage: narrow, so the quotient keeps 16 decimals.
PART = "decimal(14,2)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- literals ---------------------------------------------------------------


def as_datetime(value: date | datetime | str) -> datetime:
    """Argument → naive datetime; a ``date`` means its midnight."""
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return datetime.fromisoformat(value)


def ntz_lit(value: date | datetime | str) -> Column:
    """TIMESTAMP_NTZ literal (constant-folded, so it reaches PushedFilters)."""
    text = as_datetime(value).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


def month_bounds(month: date | datetime | str | None) -> tuple[datetime, datetime]:
    """First instant of the month and of the next month ('January 2024' labels
    accepted; None is the default month)."""
    label = month is None or isinstance(month, str) and not month[:1].isdigit()
    m = resolve_month(month) if label else as_datetime(month)
    first = datetime(m.year, m.month, 1)
    nxt = datetime(m.year + (m.month == 12), m.month % 12 + 1, 1)
    return first, nxt


def parse_month_label(label: str) -> datetime:
    """'January 2024' → 2024-01-01 (argument parsing, driver side)."""
    return datetime.strptime(label, "%B %Y")


# Fixed value: the month the reference uses when '(All)' is selected.
ALL_LABEL_MONTH = datetime(2024, 10, 1)


def resolve_month(month: date | datetime | str | None) -> datetime:
    """Month argument from a date, ISO text or a 'January 2024' label.

    '(All)' and None give the fixed month the reference substitutes for
    '(All)' (it never aggregates all months); pass a real month instead.
    """
    if month is None or month == "(All)":
        return ALL_LABEL_MONTH
    if isinstance(month, str) and not month[:1].isdigit():
        return parse_month_label(month)
    first, _ = month_bounds(month)
    return first


def default_range(today: date | None = None) -> tuple[datetime, datetime]:
    """Yesterday .. today at midnight, the dashboard's default date range."""
    d = as_datetime(today or date.today())
    return d - timedelta(days=1), d


def hour_count(start: datetime, end: datetime) -> int:
    """Index of the last hour of an hourly series start..end (end inclusive).

    -1 means the series is empty (end before start).
    """
    if end < start:
        return -1
    return int((end - start) // timedelta(hours=1))


# --- predicates ---------------------------------------------------------------


def in_range(c: Column | str, start, end) -> Column:
    """Half-open ``start <= c < end``; both bounds push down to the scan."""
    c = _col(c)
    return (c >= ntz_lit(start)) & (c < ntz_lit(end))


def in_month(c: Column | str, month) -> Column:
    """``c`` lies in the calendar month of ``month`` (range form: pushable)."""
    first, nxt = month_bounds(month)
    return in_range(c, first, nxt)


# --- time -------------------------------------------------------------------


def micros_between(begin: Column | str, end: Column | str) -> Column:
    """Exact ``end - begin`` in microseconds (BIGINT); null if either is null."""
    return F.timestamp_diff("MICROSECOND", _col(begin), _col(end))


def hour_floor(ts: Column | str) -> Column:
    """Truncate a TIMESTAMP_NTZ to its hour, staying NTZ."""
    ts = _col(ts)
    return F.make_timestamp_ntz(
        F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0)
    )


def day_floor(ts: Column | str) -> Column:
    return F.to_date(_col(ts)).cast("timestamp_ntz")


def ceil_div(num: Column, den: int) -> Column:
    """Exact integer ceiling of num / den (BIGINT num, positive den).

    The quotient is taken in DECIMAL with 18+ fractional digits, so a
    non-integer quotient can never be rounded onto an integer.
    """
    return F.ceil(num.cast(WHOLE) / F.lit(den).cast(WHOLE)).cast("long")


# --- exact rounding ------------------------------------------------------------


def round2(c: Column) -> Column:
    """ROUND(x, 2) of a DECIMAL (half away from zero)."""
    return F.round(c, 2)


def div_round2(num: Column, den: Column, num_type: str = WHOLE, den_type: str = WHOLE) -> Column:
    """ROUND(num / den, 2) computed in DECIMAL; null when den is 0 or null.

    The operand types are kept narrow so Spark keeps at least 18 fractional
    digits in the quotient, more than any quotient of counts, minutes or
    money needs to round the right way.
    """
    return F.round(num.cast(num_type) / F.nullif(den.cast(den_type), F.lit(0).cast(den_type)), 2)


def minutes2(micros: Column) -> Column:
    """Microseconds → minutes rounded to 2 places (DECIMAL)."""
    return div_round2(micros, F.lit(MICROS_PER_MINUTE))


def hours2(micros: Column) -> Column:
    """Microseconds → hours rounded to 2 places (DECIMAL)."""
    return div_round2(micros, F.lit(MICROS_PER_HOUR))


def seconds_to_minutes2(seconds: Column) -> Column:
    return div_round2(seconds, F.lit(60))


def pct2(part: Column, whole: Column, part_type: str = PART, whole_type: str = PART) -> Column:
    """ROUND(part / whole * 100, 2), multiplied first; null when whole is 0.

    The quotient keeps 16 decimals (14 for counts).
    """
    return F.round(
        (part.cast(part_type) * F.lit(100).cast("decimal(3,0)")) / F.nullif(whole.cast(whole_type), F.lit(0).cast(whole_type)), 2
    )


def to_double(c: Column) -> Column:
    return c.cast("double")


# --- text ---------------------------------------------------------------------


def nullif_blank(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def money(c: Column | str) -> Column:
    """Money stored as text → DECIMAL; '' is treated as missing (null).

    Any other non-numeric text fails the job (ANSI cast), as the database
    cast does, rather than silently dropping a cost; so do more digits than
    the type holds, which the database would keep.
    """
    text = nullif_blank(c)
    value = text.cast(MONEY)
    lost = text.rlike(r"\.\d{10}\d*[1-9]") | (text.rlike("[eE]") & (text.cast("decimal(38,20)") != value))
    return F.when(lost, F.raise_error(F.concat(F.lit("too many decimals in a cost: "), text)).cast(MONEY)).otherwise(value)


def month_label(ts: Column | str) -> Column:
    """'January 2024' style label."""
    return F.date_format(_col(ts), "MMMM yyyy")


def hour_label(ts: Column | str) -> Column:
    """'2024-01-02 13:00' (minutes floored)."""
    return F.date_format(_col(ts), "yyyy-MM-dd HH:00")


# --- durations written as text ---------------------------------------------------


def normalise_duration(d: Column | str) -> Column:
    """Text form of a duration with a ':00' seconds part added to 'H:MM'.

    Missing values become the text 'None' (as Python's ``str`` renders them),
    which then does not parse.
    """
    text = F.coalesce(_col(d).cast("string"), F.lit("None"))
    return F.when(F.size(F.split(text, ":", -1)) == 2, F.concat(text, F.lit(":00"))).otherwise(text)


# Names of units of a duration and their length in nanoseconds. Case
# does not matter, but that M, Y and y name no fixed length.
DURATION_UNITS = (
    (7 * 24 * 3600 * 10**9, ("w",)),
    (24 * 3600 * 10**9, ("d", "day", "days")),
    (3600 * 10**9, ("h", "hr", "hour", "hours")),
    (60 * 10**9, ("m", "t", "min", "minute", "minutes")),
    (10**9, ("s", "sec", "second", "seconds")),
    (10**6, ("ms", "l", "milli", "millis", "millisecond", "milliseconds")),
    (10**3, ("us", "\u00b5s", "u", "micro", "micros", "microsecond", "microseconds")),
    (1, ("ns", "n", "nano", "nanos", "nanosecond", "nanoseconds")),
)
AMBIGUOUS_UNITS = ("M", "Y", "y")

# Clock text (hours:minutes:seconds of any length, fraction of a
# second), an amount with its unit, and the ISO 8601 form.
CLOCK_PATTERN = r"^(-?)(?:(\d+):(\d+):(\d+)(?:\.(\d+))?)?$"
AMOUNT_PATTERN = r"(\d+)(?:\.(\d*))?([A-Za-z\u00b5]+)"
ISO_PATTERN = r"^(-?)P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d+))?S)?)?$"

_NANOS = "decimal(38,0)"


def _units_of(text: Column) -> Column:
    """Nanoseconds of a unit's name; null for any other word."""
    names = F.create_map(*[x for nanos, words in DURATION_UNITS for w in words for x in (F.lit(w), F.lit(nanos).cast("long"))])
    return F.when(~text.isin(*AMBIGUOUS_UNITS), F.try_element_at(names, F.lower(text)))


def _amount(whole: Column, fraction: Column, unit: Column) -> Column:
    """Nanoseconds of ``whole.fraction`` units, cut after nine places; a part that
    is not there counts as 0, one that is too long is null."""
    number = F.when(whole == "", F.lit(0)).otherwise(whole.try_cast("decimal(18,0)"))
    parts = F.rpad(F.substring(fraction, 1, 9), 9, "0").try_cast("decimal(9,0)")
    below = F.floor(F.coalesce(parts, F.lit(0)).cast("decimal(9,0)") * unit.cast("decimal(18,0)") / F.lit(10**9).cast("decimal(10,0)"))
    return F.try_add((number.cast("decimal(18,0)") * unit.cast("decimal(18,0)")).cast(_NANOS), below.cast(_NANOS))


def duration_micros(text: Column | str) -> Column:
    """Normalised duration text to microseconds (BIGINT); null if it is none, or
    longer than a BIGINT holds.

    Accepted are clock text ('25:00:00', '-1:30:00.5'), amounts with units in any
    order and number ('1h30m', '90 min', '1.5 hours', '2 days 3 hours'), both
    together ('1 days 02:00:00') and ISO 8601 ('PT1H30M'). Blanks, commas and plus signs
    between them do not count; a leading minus covers the units, or the clock where
    there are none. A bare number means nanoseconds, too few to show.
    """
    raw = _col(text)
    t = F.translate(raw, " ,+", "")

    def second(n: int) -> Column:
        return F.lit(n * 10**9).cast("long")

    def clock_part(source: Column, pattern: str, i: int, unit: int, fraction: int | None = None) -> Column:
        below = F.regexp_extract(source, pattern, fraction) if fraction else F.lit("")
        return _amount(F.regexp_extract(source, pattern, i), below, second(unit))

    def total(*terms: Column) -> Column:
        out = terms[0]
        for term in terms[1:]:
            out = F.try_add(out, term)
        return out

    rest = F.regexp_replace(t, AMOUNT_PATTERN, "")
    words, fractions, units = (F.regexp_extract_all(t, F.lit(AMOUNT_PATTERN), F.lit(i)) for i in (1, 2, 3))
    numbers = F.zip_with(words, fractions, lambda w, f: F.struct(w.alias("w"), f.alias("f")))
    amounts = F.zip_with(numbers, units, lambda n, u: _amount(n["w"], n["f"], _units_of(u)))
    in_units = F.aggregate(amounts, F.lit(0).cast(_NANOS), lambda a, x: F.try_add(a, x).cast(_NANOS))
    clock = total(clock_part(rest, CLOCK_PATTERN, 2, 3600), clock_part(rest, CLOCK_PATTERN, 3, 60), clock_part(rest, CLOCK_PATTERN, 4, 1, 5))
    minus = F.when(t.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    mixed = F.when(
        rest.rlike(CLOCK_PATTERN) & (~rest.startswith("-") | t.startswith("-")),
        total((minus * in_units).cast(_NANOS), clock),
    )
    iso = total(*[clock_part(raw, ISO_PATTERN, i, n) for i, n in ((2, 604800), (3, 86400), (4, 3600), (5, 60))], clock_part(raw, ISO_PATTERN, 6, 1, 7))
    iso_minus = F.when(raw.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    nanos = (
        F.when(t.rlike(r"^-?\d+:"), F.when(t.rlike(CLOCK_PATTERN), (minus * clock).cast(_NANOS)))  # units unseen: most texts
        .when(raw.rlike(ISO_PATTERN) & raw.rlike(r"\d"), (iso_minus * iso).cast(_NANOS))
        .when(t.rlike(r"^-?\d+$"), F.lit(0).cast(_NANOS))
        .when(F.size(units) > 0, mixed)
    )
    micros = F.floor(F.abs(nanos) / F.lit(1000).cast("decimal(4,0)")) * F.signum(nanos).cast("decimal(1,0)")
    return micros.try_cast("long")


def micros_to_hours(micros: Column) -> Column:
    """Microseconds → hours as DOUBLE (one rounding)."""
    return micros.cast("double") / F.lit(float(MICROS_PER_HOUR))
