"""Flatten, rename, id and union of landed production batches (PRJ-02..PRJ-05, SET-01)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten_hourly(records: DataFrame, list_path: str = "attributes.productionPerGroupMbaHour",
                   outer_key: str = "priceArea") -> DataFrame:
    """PRJ-04/FN-16/S13: one row per hourly entry of each record's nested list.

    A record without the attribute, or with a missing or empty list, gives
    no rows (``explode``, not ``explode_outer``).  The entry's own area wins;
    the batch key stamped on the outer record fills it when NULL, or is
    added when the entries carry no such field.  Works
    record by record inside a task: no shuffle, lists are never merged.
    """
    has_outer = outer_key in records.columns
    x = records.select(
        (F.col(outer_key) if has_outer else F.lit(None).cast("string")).alias("_outer"),
        F.explode(F.col(list_path)).alias("_e"))
    fields = x.schema["_e"].dataType.fieldNames()
    cols = []
    for f in fields:
        c = F.col(f"_e.{f}")
        if f == outer_key:
            c = F.coalesce(c, F.col("_outer"))
        cols.append(c.alias(f))
    if has_outer and outer_key not in fields:
        cols.insert(0, F.col("_outer").alias(outer_key))
    return x.select(*cols)


def stamp_key(df: DataFrame, name: str, value: str | Column) -> DataFrame:
    """PRJ-05: put the batch's key on every record."""
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def lower_case_columns(df: DataFrame) -> DataFrame:
    """PRJ-02: rename every column to lower case; fails on a clash."""
    low = [c.lower() for c in df.columns]
    if len(set(low)) != len(low):
        raise ValueError(f"lower-casing would merge columns: {df.columns}")
    return df.toDF(*low)


def with_row_id(df: DataFrame, name: str = "ind", above: int | None = None) -> DataFrame:
    """PRJ-03/FN-15: unique 64-bit id per row (not consecutive, not stable across runs).

    Partition id in the high bits, row number in the low bits: no shuffle and
    no single-partition window.  ``above`` is the largest id in use already
    (``largest_id`` of the stored table); new ids begin after it, so loads
    that follow each other never collide.
    """
    first = F.lit(0 if above is None else above + 1).cast("long")
    return df.withColumn(name, F.monotonically_increasing_id().cast("long") + first)


def largest_id(df: DataFrame, name: str = "ind") -> int | None:
    """The largest id of a stored table, or None if it is empty (one number, a two-phase maximum)."""
    return df.agg(F.max(name)).first()[0]


def union_batches(frames: Iterable[DataFrame]) -> DataFrame:
    """SET-01: bag union of batches by column name; no dedup."""
    frames = list(frames)
    if not frames:
        raise ValueError("no batches")
    return reduce(lambda a, b: a.unionByName(b), frames)
