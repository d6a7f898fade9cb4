"""Minima, maxima and counts per partition, stored by the write and merged at read (AGG-09/10, FN-07).

A partitioned table has a small table of statistics beside it: one row per
partition and metric.  Statistics of any set of partitions are the minimum
of minima and the maximum of maxima, so a scaled read needs no pass over the
metrics before its first row.  One more row, without metric, holds the rows
of the whole table; it is written with the others and after the data, so
statistics that a failed write left behind are recognised and refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.operators.normalize import as_missing, q
from wattline.sinks.writers import overwrite_partitioned

STATS = "metric STRING, n BIGINT, min_value DOUBLE, max_value DOUBLE, rows BIGINT"


class StatsError(LookupError):
    """Statistics that are not there, or not for all metrics asked for."""


def partition_stats(df: DataFrame, partition_by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per partition and metric: values that are not missing, their min and max, and the partition's rows.

    NaN counts as missing (S9); a metric without values has NULL bounds.  Two
    phases, so a hot partition sends one row per task.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(metrics):
        v = as_missing(df, c)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
    per = df.groupBy(*[F.col(q(p)) for p in partition_by]).agg(*aggs)
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"n{i}").alias("n"), F.col(f"min{i}").alias("min_value"),
                                 F.col(f"max{i}").alias("max_value")) for i, c in enumerate(metrics)])
    return per.select(*[F.col(q(p)) for p in partition_by], F.inline(entries), "rows")


def write_with_stats(df: DataFrame, path: str, stats_path: str, partition_by: list[str], metrics: Sequence[str],
                     sort_by: Sequence[str] = ()) -> int:
    """SNK-03 with statistics: overwrite the table, then store its statistics; the number of rows stored.

    The statistics are taken from the files that were written (partition and
    metric columns only), so they hold for what a reader gets.  Old ones are
    emptied before the data changes.
    """
    if not metrics or {"metric", "n", "min_value", "max_value", "rows"} & set(partition_by):
        raise ValueError("no metrics, or a partition column with the name of a statistic")
    spark, kinds = df.sparkSession, {f.name: f.dataType.simpleString() for f in df.schema}
    ddl = ", ".join(f"{q(p)} {kinds[p]}" for p in partition_by) + ", " + STATS
    spark.createDataFrame([], ddl).write.mode("overwrite").parquet(stats_path)
    overwrite_partitioned(df, path, partition_by, sort_by=sort_by)
    found = partition_stats(spark.read.schema(df.schema).parquet(path), partition_by, metrics)
    found.write.mode("append").parquet(stats_path)
    stats = spark.read.schema(ddl).parquet(stats_path)
    rows = int(stats.filter(F.col("metric") == metrics[0]).agg(F.sum("rows").alias("rows")).first()["rows"] or 0)
    spark.createDataFrame([(rows,)], "rows BIGINT").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in stats.schema[:-1]], "rows") \
        .coalesce(1).write.mode("append").parquet(stats_path)
    return rows


def stored_stats(spark: SparkSession, stats_path: str, metrics: Sequence[str]) -> DataFrame:
    """Statistics of ``metrics`` per partition, to be filtered by partition columns and merged; ``StatsError`` if incomplete.

    A table without rows has statistics without rows.
    """
    stats = spark.read.parquet(stats_path)
    # One row per metric and the whole table's.
    known = {r["metric"]: r["rows"] for r in stats.groupBy("metric").agg(F.sum("rows").alias("rows")).collect()}
    if None not in known:
        raise StatsError(f"no finished statistics in {stats_path}")
    missing = [m for m in metrics if m not in known]
    if missing and known[None]:
        raise StatsError(f"no statistics of {missing} in {stats_path}")
    return stats.filter(F.col("metric").isin(list(metrics)))
