"""Numbers and dates that arrive as text.

A plain cast raises under ANSI and accepts spellings that are not valid input (``1.5d``, ``2025``),
so a pattern guards every ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillcast.constants import MONEY

# A finite decimal number, and the same with single underscores grouping its digits.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_GROUPED = r"[0-9]+(_[0-9]+)*"
GROUPED_PATTERN = rf"^\s*[+-]?({_GROUPED}(\.({_GROUPED})?)?|\.{_GROUPED})([eE][+-]?{_GROUPED})?\s*$"

# Fixed value: an ISO date with an optional time of day and offset.
ISO_DATE_PATTERN = (
    r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ]([01][0-9]|2[0-3])(:[0-5][0-9](:[0-5][0-9]([.,][0-9]{1,6})?)?)?"
    r"(Z|[+-][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{6})?)?)?)?$"
)


def number_text(text: Column) -> Column:
    """The text in a form every numeric cast reads, or NULL where it is not a finite number."""
    grouped = text.contains("_") & text.rlike(GROUPED_PATTERN)
    return F.when(text.rlike(NUMBER_PATTERN), text).when(grouped, F.replace(text, F.lit("_"), F.lit("")))


def finite_number(text: Column) -> Column:
    """The text as a double, or NULL where it is not a finite number."""
    return finite(number_text(text))


def finite(number: Column) -> Column:
    """A number text as a double; NULL where it is too large for one."""
    value = number.try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def money(text: Column) -> Column:
    """The text as an amount, or NULL where it is not a finite number or does not fit."""
    return number_text(text).try_cast(MONEY)


def iso_date(text: Column) -> Column:
    """The date part of an ISO date, or NULL where the text is not one."""
    return F.when(text.rlike(ISO_DATE_PATTERN), F.substring(text, 1, 10).try_cast("date"))


def is_number(value: Column, is_floating: bool) -> Column:
    """True where a typed column holds a usable number."""
    return value.isNotNull() & ~F.isnan(value) if is_floating else value.isNotNull()


def local_micros(ts: Column) -> Column:
    """Microseconds of a wall-clock time, whatever the session time zone."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts)
    days = F.unix_date(ts.cast("date")).cast("bigint")
    return days * F.lit(86_400_000_000) + (seconds * 1_000_000).cast("bigint")
