"""Projection and wide/long reshaping (PRJ-01, PRJ-07..PRJ-10, PRJ-13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.timeops import hour_floor
from wattline.operators.normalize import q


def keep_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-01: keep the named columns (pruned down to the scan)."""
    return df.select(*[F.col(q(c)) for c in cols])


def single_metric(df: DataFrame, metric: str, time_col: str = "time") -> DataFrame:
    """PRJ-07: one metric against time."""
    return df.select(F.col(q(time_col)), F.col(q(metric)))


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
            var: str = "Metric", value: str = "Normalized Value") -> DataFrame:
    """PRJ-08: wide to long; names are quoted, so dots and units are fine."""
    return df.unpivot([F.col(q(i)) for i in ids], [F.col(q(c)) for c in cols], var, value)


def metric_panels(df: DataFrame, cols: Sequence[str], time_col: str = "time",
                  var: str = "Metric", value: str = "Value") -> DataFrame:
    """PRJ-13: long form without scaling plus the 1-based panel of each metric."""
    long = to_long(df, [time_col], cols, var, value)
    panel = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i + 1))])
    return long.withColumn("panel", F.element_at(panel, F.col(var)))


def ordered_arrays(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str],
                   value: str, out: str = "Trend over Time") -> DataFrame:
    """PRJ-09: one row per key with its values as an array in ``order`` order.

    Values travel inside structs, so NULL values keep their slot (a bare
    ``collect_list`` would drop them).  The caller keys the rows so that a
    group is bounded, e.g. (metric, year, month) over hourly points gives
    at most 744 values; never key an array by something that grows with
    the data.
    """
    pts = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(value).alias("v"))
    return (df.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(pts)).alias("_pts"))
            .withColumn(out, F.transform("_pts", lambda p: p["v"]))
            .drop("_pts"))


def ordered_series(df: DataFrame, group: str, time_col: str, *tie: str) -> DataFrame:
    """PRJ-10/SRT-01: rows in (group, time) order for one line per group.

    A global sort: range partitioning on (group, time) splits a hot group
    across many tasks, which a per-group repartition would not.
    """
    return df.orderBy(group, time_col, *tie)


def metric_series(df: DataFrame, cols: Sequence[str], time_col: str = "time",
                  var: str = "Metric", out: str = "Trend over Time") -> DataFrame:
    """PRJ-09 for a wide series: one row per (metric, year, month), hourly values in time order.

    First one value per (metric, hour): the largest present (an hour holds
    one row in an hourly series, so nothing changes there; NULL only if all
    are).  So an array has at most 744 values however many rows or years the
    table holds.
    """
    hour = hour_floor(F.col(q(time_col))).alias("_hour")
    hourly = df.groupBy(hour).agg(*[F.max(F.col(q(c))).alias(c) for c in cols])
    long = to_long(hourly, ["_hour"], cols, var, "_value")
    return ordered_arrays(long, [var, F.year("_hour").alias("year"), F.month("_hour").alias("month")],
                          ["_hour"], "_value", out)


def numbered_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], folder: str, out: str = "position") -> DataFrame:
    """``df`` with each row's 0-based position within its ``keys``, by ``order`` (NULLs first), however large a key's group is.

    Range partitioning on (keys, order) splits a hot key over many tasks; the
    sorted rows are stored under ``folder`` (shared, not yet existing), so
    the numbers of a lost task come out the same.  Rows are then counted per
    (task, key): a list of at most tasks + keys rows, whose running sums give
    every task's first position.  Rows equal in keys and order may take each
    other's positions.
    """
    by = [F.col(q(c)) for c in (*keys, *order)]
    spark = df.sparkSession
    (df.repartitionByRange(*by).sortWithinPartitions(*by)
     .withColumn("_at", F.monotonically_increasing_id()).write.parquet(folder))
    rows = spark.read.schema(df.schema.add("_at", "long")).parquet(folder).withColumn("_task", F.shiftright("_at", 33))
    named = [F.col(q(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    before = Window.partitionBy(*ks).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy(F.col("_task").alias("_t"), *named).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
              .select("_t", *ks, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_shift")))
    same = F.col("_task") == F.col("_t")
    for i, k in enumerate(keys):
        same = same & F.col(q(k)).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(starts, same).withColumn(out, F.col("_at") + F.col("_shift")).select(*[q(c) for c in df.columns], out)


def metric_chunks(df: DataFrame, cols: Sequence[str], folder: str, time_col: str = "time", size: int = 4096,
                  var: str = "Metric", out: str = "Trend over Time") -> DataFrame:
    """PRJ-09 without loss: every value of every metric in time order, as arrays of at most ``size``.

    One row per (metric, year, month, chunk): chunk ``k`` holds the values of
    the month's rows ``k * size`` to ``(k + 1) * size - 1`` by time, then by
    the metrics in the order given (NULLs first), so chunks one after the
    other are the month's whole list, in the same row order for all metrics,
    and an array is bounded whatever a month or an hour holds.  NULL values
    keep their slots; rows without a time make a month of their own (NULL).
    ``folder`` is where the sorted rows are stored.
    """
    t = F.col(q(time_col))
    rows = df.select(F.year(t).alias("year"), F.month(t).alias("month"), t.alias("_time"),
                     *[F.col(q(c)).alias(f"_v{i}") for i, c in enumerate(cols)])
    values = [f"_v{i}" for i in range(len(cols))]
    placed = numbered_in_order(rows, ["year", "month"], ["_time", *values], folder, "_position")
    chunks = (placed.groupBy("year", "month", F.floor(F.col("_position") / size).alias("chunk"))
              .agg(F.array_sort(F.collect_list(F.struct("_position", *values))).alias("_rows")))
    lists = [F.struct(F.lit(c).alias("metric"), F.col(f"_rows.{v}").alias("values")) for c, v in zip(cols, values)]
    m = chunks.select("year", "month", "chunk", F.explode(F.array(*lists)).alias("_m"))
    return m.select(F.col("_m.metric").alias(var), "year", "month", "chunk", F.col("_m.values").alias(out))
