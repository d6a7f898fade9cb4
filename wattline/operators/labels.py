"""Colours, axis tags, pick lists, first rows, share labels (PRJ-11, PRJ-12, SET-02, SRT-02..04, FN-09/10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.calendar import ALL_MONTHS, AREA_SENTINELS, COLUMN_SENTINEL, MONTH_NAMES
from wattline.functions.colours import (DOMINANT_GROUP, PRICE_AREAS, PRODUCTION_GROUPS, axis_of,
                                        colour_of)
from wattline.functions.text import percent_label, thousands


def with_colour(df: DataFrame, group: str = "productiongroup", name: str = "colour") -> DataFrame:
    """PRJ-11/JN-03: colour per group, default for unknown groups."""
    return df.withColumn(name, colour_of(F.col(group)))


def with_axis(df: DataFrame, group: str = "productiongroup", dominant: str = DOMINANT_GROUP,
              name: str = "axis") -> DataFrame:
    """PRJ-12: dominant group on the primary axis, the rest on the secondary."""
    return df.withColumn(name, axis_of(F.col(group), dominant))


def pick_list(df: DataFrame, col: str, sentinel: str | None) -> DataFrame:
    """AGG-11 + SRT-02 + SET-02: sentinel first, then the sorted distinct values.

    Output ``(ord, value)``; the distinct is a two-phase aggregate, the
    sentinel is one literal row, the final sort runs on distinct values only.
    """
    vals = (df.select(F.col(col).cast("string").alias("value"))
            .filter(F.col("value").isNotNull()).distinct()
            .withColumn("ord", F.lit(1)))
    if sentinel is not None:
        top = df.sparkSession.range(1).select(F.lit(0).alias("ord"), F.lit(sentinel).alias("value"))
        vals = top.unionByName(vals)
    return vals.select("ord", "value").orderBy("ord", "value")


def column_options(df: DataFrame, time_col: str = "time") -> list[str]:
    """SET-02 for the metric selector: ``All Columns`` then every metric (plan time, no job)."""
    return [COLUMN_SENTINEL] + [c for c in df.columns if c != time_col]


def month_options() -> list[str]:
    """SET-02 for the month selector: ``All months`` then the calendar names."""
    return [ALL_MONTHS] + list(MONTH_NAMES)


def area_options() -> list[str]:
    """SET-02 for the area selector: ``All Areas`` then the five price areas."""
    return [AREA_SENTINELS[1]] + list(PRICE_AREAS)


def group_options() -> list[str]:
    """The group choices (no sentinel: an empty choice means every group, FLT-04)."""
    return list(PRODUCTION_GROUPS)


def first_rows(df: DataFrame, n: int, order: Sequence[str] | None = None) -> DataFrame:
    """SRT-03: first ``n`` rows; with an order this is a top-k (no full sort)."""
    return (df.orderBy(*order) if order else df).limit(n)


def share_labels(df: DataFrame, group: str = "productiongroup", share: str = "share",
                 total: str = "area_total") -> DataFrame:
    """FN-09/FN-10: ``total_label`` with thousands separators and ``label`` like ``hydro, 61.2%``."""
    return (df.withColumn("total_label", thousands(F.col(total)))
              .withColumn("label", percent_label(F.col(group), F.col(share))))
