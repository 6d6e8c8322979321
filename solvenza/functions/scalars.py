"""Text, time, grade, percentage and lookup functions on columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

from solvenza.schemas import GRADE_SCALE, HELD, LOWERED, NO_VALUE, RAISED


# --- text -----------------------------------------------------------------

def contains_ignoring_case(text: Column, term: Column) -> Column:
    """Literal substring test; ``%`` and ``_`` have no special meaning."""
    return F.contains(F.lower(text), F.lower(term))


def trim_spaces(text: Column) -> Column:
    """Trim every Unicode space; the built-in ``trim`` removes U+0020 only."""
    return F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(trim_spaces(text) == "", F.lit(True))


def strip_trailing_slash(text: Column) -> Column:
    return F.regexp_replace(text, "/$", "")


def or_default(value: Column, default: str = NO_VALUE) -> Column:
    """``default`` for NULL and for the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def map_lookup(mapping: Column, key: Column, default: str = NO_VALUE) -> Column:
    return or_default(F.try_element_at(mapping, key), default)


def change_text(before: Column, after: Column) -> Column:
    return F.concat(before, F.lit(" → "), after)


# --- urls -----------------------------------------------------------------

def is_likely_url(text: Column) -> Column:
    return F.coalesce(trim_spaces(text).rlike(r"(?i)^https?://\S+$"), F.lit(False))


# Ports that belong to a scheme and are not shown.
_DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}


def url_host(url: Column) -> Column:
    """Lower-case host with any non-default port.

    Text that is no URL comes back unchanged; NULL and empty give ``-``.
    Internationalised hosts are not converted to punycode.
    """
    parts = r"(?i)^\s*(https?|wss?|ftp)://(?:[^/?#@\\]*@)?([^/?#@\\\s<>^|%]+)(?:[/?#\\].*)?$"
    scheme = F.lower(F.regexp_extract(url, parts, 1))
    host = F.lower(F.regexp_extract(url, parts, 2))
    shown = host
    for name, port in _DEFAULT_PORTS.items():
        shown = F.when(scheme == name, F.regexp_replace(host, f":({port})?$", "")).otherwise(shown)
    return or_default(F.coalesce(F.nullif(shown, F.lit("")), url))


# --- time -----------------------------------------------------------------

def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 from the clock fields, whatever the session zone."""
    return (
        F.unix_date(ts.cast("date")).cast("long") * 86400
        + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    )


_EPOCH = "1970-01-01 00:00:00"


def micros(ts: Column) -> Column:
    """Whole microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), ts)


def from_micros(at: Column) -> Column:
    return F.timestamp_add("MICROSECOND", at, F.lit(_EPOCH).cast("timestamp_ntz"))


def moment(ts: str, number: str) -> Column:
    """Time and then number as one DECIMAL(38,0), to order rows by both.

    A fixed-width value: aggregates that order by it keep hash buffers, those that
    order by a struct sort all rows first.
    """
    day, second = F.col(ts), F.extract(F.lit("SECOND"), F.col(ts))
    minutes = F.unix_date(day.cast("date")).cast("long") * 1440 + F.hour(day) * 60 + F.minute(day)
    micros = minutes * 60_000_000 + (second * 1_000_000).cast("long")
    place = F.col(number).cast("decimal(20,0)") + F.lit(Decimal(2**63))
    return (micros.cast("decimal(18,0)") * F.lit(Decimal(2**64)) + place).cast("decimal(38,0)")


def bucket_start(ts: Column, minutes: int = 3) -> Column:
    """Start of the bucket that holds ``ts``; ``minutes`` has to divide an hour."""
    if minutes <= 0 or 60 % minutes:
        raise ValueError("bucket width must divide 60 minutes")
    return F.window(ts, f"{minutes} minutes").getField("start")


def quarter_start(ts: Column) -> Column:
    day = ts.cast("date")
    return F.make_date(F.year(day), F.quarter(day) * 3 - 2, F.lit(1)).cast("timestamp_ntz")


def quarter_number(day: Column) -> Column:
    """Consecutive quarters get consecutive integers."""
    return F.year(day) * 4 + F.quarter(day) - 1


def quarter_label(day: Column, is_estimate: Column | None = None) -> Column:
    label = F.concat(F.lit("Q"), F.quarter(day), F.lit(" "), F.year(day))
    if is_estimate is None:
        return label
    return F.concat(label, F.when(is_estimate, F.lit(" (E)")).otherwise(F.lit("")))


def _two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def _half_day(ts: Column) -> Column:
    return F.when(F.hour(ts) < 12, F.lit("오전")).otherwise(F.lit("오후"))


def _clock_hour(ts: Column) -> Column:
    return F.pmod(F.hour(ts) + 11, F.lit(12)) + 1


def short_time_label(ts: Column) -> Column:
    """Month, day, half of the day, hour and minute, two digits each."""
    return F.concat(
        _two(F.month(ts)), F.lit(". "), _two(F.day(ts)), F.lit(". "), _half_day(ts),
        F.lit(" "), _two(_clock_hour(ts)), F.lit(":"), _two(F.minute(ts)),
    )


def full_time_label(ts: Column) -> Column:
    """Year to second as the Korean locale prints it."""
    return F.concat(
        F.year(ts).cast("string"), F.lit(". "), F.month(ts).cast("string"), F.lit(". "),
        F.day(ts).cast("string"), F.lit(". "), _half_day(ts), F.lit(" "),
        _clock_hour(ts).cast("string"), F.lit(":"), _two(F.minute(ts)), F.lit(":"),
        _two(F.second(ts)),
    )


# --- grades ---------------------------------------------------------------

def _scale() -> Column:
    return F.array(*map(F.lit, GRADE_SCALE))


def grade_index(grade: Column) -> Column:
    """Position on the scale, 0 for the best grade, -1 when it is not on it."""
    return F.coalesce(F.array_position(_scale(), grade).cast("int") - 1, F.lit(-1))


def grade_label(index: Column) -> Column:
    """Grade at a position; empty text off the scale."""
    on_scale = (index >= 0) & (index < len(GRADE_SCALE))
    place = F.when(on_scale, index + 1).otherwise(1).cast("int")
    return F.when(on_scale, F.element_at(_scale(), place)).otherwise(F.lit(""))


def direction(before: Column, now: Column) -> Column:
    """Lower positions are better grades; without an earlier grade nothing moved."""
    return (
        F.when(now < before, F.lit(RAISED)).when(now > before, F.lit(LOWERED)).otherwise(F.lit(HELD))
    )


# --- numbers and percentages -----------------------------------------------

# A decimal number with optional exponent; a cast alone also takes "1d" and "1f".
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_number(text: Column) -> Column:
    """Double, or NULL when the text is not a finite number. Spaces around it do not
    count, and blank text is 0."""
    bare = trim_spaces(text)
    number = F.when(bare == "", F.lit(0.0)).when(bare.rlike(_NUMBER), bare.try_cast("double"))
    return F.when(is_finite(number), number)


def is_finite(number: Column) -> Column:
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))


def round_half_up(number: Column) -> Column:
    """Nearest integer, ties towards positive infinity."""
    return F.floor(number + 0.5)


# From here on doubles lie further apart than the four decimals that are kept, and
# ten thousand times the value nears the end of BIGINT.
_COARSE = 9e13


def basis_points(number: Column) -> Column:
    """The fraction in hundredths of a percent, ties away from zero, as BIGINT. Of
    fractions below 9e13 only."""
    return (F.signum(number) * F.floor(F.abs(number) * 10000 + 0.5)).cast("long")


def to_percentage(number: Column, missing: str = "zero") -> Column:
    """Fraction as text with two decimals and ``%``.

    ``missing="zero"`` prints NULL as ``0.00%``; ``missing="null"`` prints ``-``.
    NaN and the infinities always print ``-``.
    """
    value = F.coalesce(number, F.lit(0.0)) if missing == "zero" else number
    points = F.abs(basis_points(value))
    text = F.concat(
        F.when(value < 0, F.lit("-")).otherwise(F.lit("")),
        F.floor(points / 100).cast("string"), F.lit("."), _two(points % 100), F.lit("%"),
    )
    exact = (F.abs(value).try_cast("decimal(34,2)") * 100).cast("decimal(38,2)").cast("string")
    large = F.concat(
        F.when(value < 0, F.lit("-")).otherwise(F.lit("")),
        F.coalesce(exact, F.abs(value * 100).cast("string")), F.lit("%"),
    )
    shown = F.when(F.abs(value) < _COARSE, text).otherwise(large)
    return F.when(is_finite(value), shown).otherwise(F.lit(NO_VALUE))


def parse_percentage(text: Column) -> Column:
    """Fraction from percentage text; ``-`` is NULL, plain numbers stay as they are."""
    bare = F.regexp_replace(text, "%$", "")
    return (
        F.when(F.endswith(text, F.lit("%")), to_number(bare) / 100)
        .when(text == NO_VALUE, F.lit(None).cast("double"))
        .otherwise(to_number(text))
    )


def stored_ratio(number: Column, missing: str = "zero") -> Column:
    """What parsing the printed percentage gives back, without the text in between."""
    value = F.coalesce(number, F.lit(0.0)) if missing == "zero" else number
    rounded = F.when(F.abs(value) < _COARSE, basis_points(value) / 100.0 / 100.0).otherwise(value)
    return F.when(is_finite(value), rounded)


def displayed_count(ratio: Column, total: Column) -> Column:
    return round_half_up(F.coalesce(ratio, F.lit(0.0)) * F.coalesce(total, F.lit(0)))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def plain_number(number: Column) -> Column:
    """Double as text without a trailing ``.0``."""
    return F.regexp_replace(number.cast("string"), r"\.0$", "")
