"""Totals per area, group, hour and day, with all-area totals and shares (AGG-01..AGG-12).

Null rules differ by origin (SURVEY S1/S2): the notebook's Spark aggregates
keep NULL keys and give NULL for an all-NULL group; the app's pandas
aggregates drop NULL keys and give 0.0.  Sums are taken in the input type
(exact for decimals) and cast to double at the end.

All aggregates are two-phase (partial per task, then a shuffle of one row
per group per task), so a group holding a third of the rows costs no more
shuffle than any other group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.calendar import AREA_SENTINELS
from wattline.functions.timeops import day_floor
from wattline.operators.filters import in_area

TOTAL = AREA_SENTINELS[0]


def _sum_double(c: str) -> Column:
    return F.sum(c).cast("double")


def _sum_or_zero(c: str) -> Column:
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


def area_group_totals(df: DataFrame, value: str = "quantitykwh") -> DataFrame:
    """AGG-01: total per (area, group) as ``Total_Kwh``; NULL keys kept, all-NULL gives NULL."""
    return df.groupBy("pricearea", "productiongroup").agg(_sum_double(value).alias("Total_Kwh"))


def area_group_with_total(df: DataFrame, value: str = "quantitykwh", raw: bool = False) -> DataFrame:
    """AGG-01 + AGG-02: per (area, group) rows plus ``Total`` rows per group.

    The facts are aggregated once per (area, group); the ``Total`` rows
    re-aggregate that small summary, as the reference does, instead of a
    grouping-sets ``Expand`` that would double every fact row before the
    partial aggregate.  Both branches read the same shuffle (reused), so
    the facts are scanned once.  Per-area rows keep Spark's rules; ``Total``
    rows follow the pandas re-aggregation: NULL groups dropped, all-NULL
    sums become 0.  ``raw`` keeps the sums in the input type (exact shares).
    """
    per = df.groupBy("pricearea", "productiongroup").agg(F.sum(value).alias("Total_Kwh"))
    # The NULL group is dropped by a test on an aggregate output: a filter on
    # the grouping key itself would be pushed below both aggregates into the
    # scan, and the two branches would no longer share one shuffle.
    total = (per.groupBy("productiongroup")
             .agg(F.coalesce(F.sum("Total_Kwh"), F.lit(0)).alias("Total_Kwh"),
                  F.max(F.col("productiongroup").isNull()).alias("_null_group"))
             .filter(~F.col("_null_group"))
             .select(F.lit(TOTAL).alias("pricearea"), "productiongroup", "Total_Kwh"))
    out = per.unionByName(total)
    return out if raw else out.withColumn("Total_Kwh", F.col("Total_Kwh").cast("double"))


def area_selection(summary: DataFrame, area: str | None) -> DataFrame:
    """FLT-07 + CCH-01: serve an area choice from the ``area_group_with_total`` summary.

    ``None``, ``Total`` or ``All Areas`` pick the all-area rows; any other
    value picks that area's rows.  Persist the summary (``cached``) when
    several selections are served from it.
    """
    key = TOTAL if area is None or area in AREA_SENTINELS else area
    return summary.filter(F.col("pricearea") == key)


def hourly_group_totals(df: DataFrame, time_col: str = "starttime",
                        value: str = "quantitykwh") -> DataFrame:
    """AGG-03: total over areas per (hour, group); Spark null rules."""
    return df.groupBy(time_col, "productiongroup").agg(_sum_double(value).alias(value))


def group_totals(df: DataFrame, value: str = "quantitykwh") -> DataFrame:
    """AGG-04: total per group from facts; NULL groups dropped, all-NULL gives 0.0."""
    return (df.filter(F.col("productiongroup").isNotNull())
            .groupBy("productiongroup").agg(_sum_or_zero(value).alias(value)))


def area_group_totals_for(df: DataFrame, area: str | None, value: str = "quantitykwh") -> DataFrame:
    """AGG-05: AGG-04 within one area (or all areas for a sentinel)."""
    return group_totals(in_area(df, area), value)


def daily_group_totals(df: DataFrame, time_col: str = "starttime",
                       value: str = "quantitykwh") -> DataFrame:
    """AGG-06: total per (day, group); rows with a NULL day or group are dropped (S1, S5)."""
    d = day_floor(time_col).alias("date")
    return (df.select(d, "productiongroup", value)
            .filter(F.col("date").isNotNull() & F.col("productiongroup").isNotNull())
            .groupBy("date", "productiongroup").agg(_sum_or_zero(value).alias(value)))


def grand_total(df: DataFrame, value: str = "quantitykwh", name: str = "total") -> DataFrame:
    """AGG-07: one row with the total; an empty input gives 0.0."""
    return df.agg(_sum_or_zero(value).alias(name))


def shares(summary: DataFrame, key: str = "pricearea", value: str = "Total_Kwh") -> DataFrame:
    """AGG-08 + FLT-09 per key: each row's share of its key's total.

    Runs on an aggregated summary, never on facts: the window partition of
    one key holds one row per group of that key, so it stays small however
    many facts fed it.  Keys whose total is not > 0 are dropped (the guard).
    """
    w = Window.partitionBy(key)
    tot = F.sum(value).over(w)
    return (summary.withColumn("area_total", tot)
            .filter(F.col("area_total") > 0)
            .withColumn("share", F.col(value).cast("double") / F.col("area_total").cast("double"))
            .withColumn(value, F.col(value).cast("double"))
            .withColumn("area_total", F.col("area_total").cast("double")))


def batch_counts(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """AGG-12: rows per batch key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
