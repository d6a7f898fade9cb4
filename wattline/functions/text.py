"""Display text: thousands, percent labels, percent-encoding (FN-09, FN-10, FN-14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(c: Column) -> Column:
    """FN-09: ``1,234,568`` (no decimals)."""
    return F.format_number(c, 0)


def percent_label(label: Column, share: Column) -> Column:
    """FN-10: ``group, 12.3%`` from a 0..1 share.

    Ties round half-up here (Java formatting); Python rounds the binary
    value, so e.g. 12.25 shows as 12.3 here and 12.2 there (S12).  Keep the
    numeric share for checks; the label is for display.  A NULL group is
    labelled ``unknown``.
    """
    return F.format_string("%s, %.1f%%", F.coalesce(label, F.lit("unknown")), share * F.lit(100.0))


def url_quote(c: Column) -> Column:
    """FN-14: percent-encode every reserved character (``:`` and ``+`` too)."""
    return F.url_encode(c)
