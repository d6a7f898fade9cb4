"""Whole-column min/max and min-max scaling of wide metric tables (AGG-09, JN-02, FN-07, FN-08).

The stats of all metrics come from one aggregate (one scan, partial
min/max per task) returned as a single struct by a scalar subquery.  Spark
runs that subquery once and inlines the result as a literal in the scaling
projection: no join, no broadcast of anything that grows, and no window
that would pull rows into one partition.  Scaling therefore reads the
metric columns twice (stats, then the scaled rows); both reads are pruned
and neither shuffles rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def q(name: str) -> str:
    """Back-quote a column name (names carry dots, spaces and units)."""
    return "`" + name.replace("`", "``") + "`"


def metric_columns(df: DataFrame, time_col: str = "time") -> list[str]:
    """PRJ-06: every column except the time column (plan time, no job)."""
    return [c for c in df.columns if c != time_col]


def as_missing(df: DataFrame, col: str) -> Column:
    """S9: a float NaN means a missing value, as in pandas."""
    c = F.col(q(col))
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(c, F.lit(None).cast("double"))
    return c.cast("double")


def _min_max_aggs(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """``min{i}``, ``max{i}`` of every metric, NaN read as missing."""
    aggs = []
    for i, c in enumerate(cols):
        v = as_missing(df, c)
        aggs += [F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
    return aggs


def stats_struct(df: DataFrame, cols: Sequence[str]) -> Column:
    """AGG-09 as one scalar: ``struct(min0, max0, min1, max1, ...)`` over ``df``."""
    return df.select(F.struct(*_min_max_aggs(df, cols)).alias("s")).scalar()


def merged_stats_struct(stats: DataFrame, cols: Sequence[str]) -> Column:
    """``stats_struct`` from stored rows ``(metric, min_value, max_value)``, one per partition and metric."""
    aggs = []
    for i, c in enumerate(cols):
        own = F.col("metric") == c
        aggs += [F.min(F.when(own, F.col("min_value"))).alias(f"min{i}"), F.max(F.when(own, F.col("max_value"))).alias(f"max{i}")]
    return stats.select(F.struct(*aggs).alias("s")).scalar()


def column_min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG-09: ``(metric, min_value, max_value)`` per metric from a single scan."""
    one = df.agg(*_min_max_aggs(df, cols))
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"min{i}").alias("min_value"),
                              F.col(f"max{i}").alias("max_value")) for i, c in enumerate(cols)])
    return one.select(F.inline(rows))


def scale_min_max(df: DataFrame, cols: Sequence[str], stats_from: DataFrame | None = None,
                  mode: str = "keep_nulls", stored: DataFrame | None = None) -> DataFrame:
    """FN-07 / FN-08: scale each metric to 0..1 with its min and max.

    ``stats_from`` sets the scope of the min and max (S7): the app scales
    with the stats of the rows it shows, the notebook with all rows; by
    default the stats come from ``df`` itself.  ``stored`` gives rows of stored
    statistics instead (``wattline.sinks.stats.stored_stats``, filtered to the
    partitions of the scope); then ``df`` is read once.

    A constant column (min == max) gives, per mode (S8):
      * ``keep_nulls`` (app): ``x - min``, so 0 and NULL stays NULL;
      * ``zero_fill`` (notebook): 0 in every row, NULLs included.
    An all-NULL column stays NULL in both modes.
    """
    if mode not in ("keep_nulls", "zero_fill"):
        raise ValueError(f"unknown mode {mode}")
    src = df if stats_from is None else stats_from
    st = "__stats"
    x = df.withColumn(st, stats_struct(src, cols) if stored is None else merged_stats_struct(stored, cols))
    out = {}
    for i, c in enumerate(cols):
        v = as_missing(x, c)
        mn, mx = F.col(f"{st}.min{i}"), F.col(f"{st}.max{i}")
        const = v - mn if mode == "keep_nulls" else F.lit(0.0)
        out[c] = F.when(mx == mn, const).otherwise((v - mn) / (mx - mn))
    return x.select(*[out[c].alias(c) if c in out else F.col(q(c)) for c in df.columns])
