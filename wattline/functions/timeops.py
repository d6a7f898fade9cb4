"""Time parsing, truncation and month-window arithmetic (FN-01..FN-05, FN-11..FN-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_timestamp(c: Column | str) -> Column:
    """FN-01: text to naive timestamp; malformed text fails the job (ANSI cast)."""
    return _c(c).cast("timestamp_ntz")


def lenient_utc(c: Column | str) -> Column:
    """FN-02: ISO text with offset to naive UTC; bad or NULL text gives NULL.

    The text must begin with a full date: a bare time would take today's
    date and a bare year its first day, neither of which the text says.

    Needs the session time zone to be UTC (``wattline.use_utc``): the text is
    parsed to an instant, and the instant is shown in the session zone.
    """
    text = _c(c)
    return F.when(text.rlike(r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(text)).cast("timestamp_ntz")


def day_floor(c: Column | str) -> Column:
    """FN-04: midnight of the same day, kept zone-less.

    Through ``date`` rather than ``date_trunc``: for a naive timestamp both
    casts are zone-free, so no session-zone arithmetic runs per row.
    """
    return _c(c).cast("date").cast("timestamp_ntz")


def hour_floor(c: Column | str) -> Column:
    """Start of the hour, kept zone-less (hourly production grain)."""
    return F.date_trunc("hour", _c(c)).cast("timestamp_ntz")


def text_part(c: Column | str, pos: int, length: int) -> Column:
    """FN-05: 1-based substring."""
    return F.substring(_c(c), pos, length)


def month_window_end(start: Column, range_end: Column) -> Column:
    """FN-12: day before the next month's start, clipped to the range end."""
    return F.least(F.date_sub(F.add_months(start, 1), 1), range_end)


# Fixed value: the request bounds use midnight at a fixed +01:00 offset.
REQUEST_OFFSET = "+01:00"


def iso_midnight(d: Column, offset: str = REQUEST_OFFSET) -> Column:
    """FN-13: date to ``yyyy-MM-ddT00:00:00+01:00``."""
    return F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00:00:00" + offset))


def month_year_label(c: Column | str) -> Column:
    """FN-11: ``Jan 2024``."""
    return F.date_format(_c(c), "MMM yyyy")


def day_label(c: Column | str) -> Column:
    """FN-11: ``05``."""
    return F.date_format(_c(c), "dd")


def day_month_year_label(c: Column | str) -> Column:
    """FN-11: ``05 Mar 2021``."""
    return F.date_format(_c(c), "dd MMM yyyy")
