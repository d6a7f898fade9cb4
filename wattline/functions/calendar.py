"""Month names and numbers (FN-06)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's selector texts.
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]
ALL_MONTHS = "All months"
AREA_SENTINELS = ("Total", "All Areas")
COLUMN_SENTINEL = "All Columns"


def month_number(name: str) -> int:
    """Calendar name to 1..12; raises on an unknown name."""
    return MONTH_NAMES.index(name) + 1


def month_name(month: Column) -> Column:
    """Month number column (1..12) to its full English name."""
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM")


def month_number_of_name(name: Column) -> Column:
    """Month name column to number; unknown names give NULL."""
    lookup = F.create_map(*[x for i, n in enumerate(MONTH_NAMES)
                            for x in (F.lit(n), F.lit(i + 1))])
    return F.try_element_at(lookup, name)
