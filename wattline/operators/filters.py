"""Row filters (FLT-01..FLT-09).

Predicates are written on bare columns where the semantics allow, so they
reach the Parquet scan (``PushedFilters``) or prune partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.calendar import ALL_MONTHS, AREA_SENTINELS, month_number


def in_month(df: DataFrame, time_col: str, month: int, year: int | None = None,
             partition_month: str | None = None) -> DataFrame:
    """FLT-01: rows in one calendar month of any year (S4).

    With ``year`` the test becomes a half-open time range, which Parquet
    can push down and row groups can skip.  ``partition_month`` names a
    partition column holding ``month(time)`` (the SNK-03 layout); the same
    test on it prunes whole folders.
    """
    t = F.col(f"`{time_col}`")
    if partition_month is not None:
        df = df.filter(F.col(partition_month) == month)
    if year is None:
        return df.filter(F.month(t) == month)
    lo = F.make_timestamp_ntz(F.lit(year), F.lit(month), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return df.filter((t >= lo) & (t < F.add_months(lo, 1).cast("timestamp_ntz")))


def in_month_range(df: DataFrame, time_col: str, first: int | None = None,
                   last: int | None = None, partition_month: str | None = None) -> DataFrame:
    """FLT-02: rows whose month is in ``[first, last]``, any year.

    An open bound means no limit on that side; with neither bound every
    row is kept (the slider's default is the full range, S10).
    ``partition_month`` prunes folders as in ``in_month``.
    """
    for m in [F.month(F.col(f"`{time_col}`"))] + ([F.col(partition_month)] if partition_month else []):
        if first is not None:
            df = df.filter(m >= first)
        if last is not None:
            df = df.filter(m <= last)
    return df


def in_area(df: DataFrame, area: str | None, col: str = "pricearea") -> DataFrame:
    """FLT-03/FLT-07: one price area; ``None``, ``Total`` or ``All Areas`` keep all."""
    if area is None or area in AREA_SENTINELS:
        return df
    return df.filter(F.col(col) == area)


def in_groups(df: DataFrame, groups: Sequence[str] | None, col: str = "productiongroup") -> DataFrame:
    """FLT-04: rows whose group is in the set; an empty set means no filter."""
    if not groups:
        return df
    return df.filter(F.col(col).isin(list(groups)))


def in_named_month(df: DataFrame, time_col: str, name: str | None,
                   partition_month: str | None = None) -> DataFrame:
    """FLT-05: month given by name (of the parsed, UTC time); ``All months`` keeps all.

    ``partition_month`` names a partition column with the month of the local
    text.  An offset moves a time by less than a day, so the UTC month lies
    in the local month or a neighbour: that test prunes folders and the exact
    one decides.
    """
    if name is None or name == ALL_MONTHS:
        return df
    m = month_number(name)
    if partition_month is not None:
        df = df.filter(F.col(partition_month).isin((m - 2) % 12 + 1, m, m % 12 + 1))
    return df.filter(F.month(F.col(time_col)) == m)


def text_year_month(df: DataFrame, text_col: str, year: int, month: int) -> DataFrame:
    """FLT-06: year and month tested on the local timestamp text.

    ``startswith('2021-01')`` equals the two substring tests on ISO text and
    is pushed into the Parquet scan as a string-prefix filter.
    """
    return df.filter(F.col(text_col).startswith(f"{year:04d}-{month:02d}"))


def production_selection(df: DataFrame, area: str | None = None,
                         groups: Sequence[str] | None = None,
                         month: str | None = None, time_col: str = "starttime") -> DataFrame:
    """FLT-08: area AND groups AND month, each optional; Catalyst fuses them into one filter."""
    return in_named_month(in_groups(in_area(df, area), groups), time_col, month)


def keep_if_positive_total(df: DataFrame, value_col: str) -> DataFrame:
    """FLT-09: keep the rows only if the result is non-empty with a total > 0.

    The total is a scalar subquery: computed once (partial sums per task,
    one row to the driver) and used as a literal; no join, no window.
    """
    total = df.select(F.sum(value_col)).scalar()
    return df.filter(F.coalesce(total > 0, F.lit(False)))
