"""Keyed merges into a day-partitioned table: of rows with one key the latest stays (SET-01/S18).

Requests for neighbouring windows share their edge hours, and the source
corrects values later, so a key can come more than once.  A merge reads the
days its rows name, writes these days anew to a folder of its own and then
points each day's partition there.  A day shows its old rows or its new
ones, never a mix; a merge done again, also after half of it, gives the same
rows.  One writer at a time per table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.sinks.writers import _name, _text

DAY = "day"
NO_DAY = "none"


def day_of(text: Column) -> Column:
    """The local day of a time text; ``none`` for what does not begin with a date."""
    first = F.substring(text, 1, 10)
    return F.when(first.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), first).otherwise(F.lit(NO_DAY))


def create_latest_table(spark: SparkSession, table: str, ddl: str, location: str) -> None:
    """An empty table of columns ``ddl``, partitioned by day."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(table)}")
    spark.sql(f"CREATE TABLE {_name(table)} ({ddl}, {DAY} STRING) USING parquet PARTITIONED BY ({DAY}) LOCATION {_text(location)}")


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per ``keys``: the one with the largest ``version``, then with the largest other columns in turn.

    NULL is a key like any other, and smaller than any version.  A two-phase
    maximum, so a key that repeats a million times is one row per task
    before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c != version]
    best = df.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}") for c in df.columns])


def merge_latest(df: DataFrame, table: str, folder: str, keys: list[str], version: str, time_text: str) -> int:
    """Merge ``df`` (the table's columns without the day) into ``table``; returns the number of days written.

    The days of ``df`` come to the driver, as names of partitions.
    """
    spark = df.sparkSession
    columns = [c for c in spark.table(table).columns if c != DAY]
    new = df.select(*columns).withColumn(DAY, day_of(F.col(time_text)))
    days = sorted(r[0] for r in new.select(DAY).distinct().collect())
    if not days:
        return 0
    stored = spark.table(table).filter(F.col(DAY).isin(days)).select(*columns, DAY)
    at = f"{folder}/{uuid.uuid4().hex}"
    latest(stored.unionByName(new), [*keys, DAY], version).hint("rebalance", DAY).write.partitionBy(DAY).parquet(at)
    for d in days:
        part, place = f"PARTITION ({DAY} = {_text(d)})", _text(f"{at}/{DAY}={d}")
        spark.sql(f"ALTER TABLE {_name(table)} ADD IF NOT EXISTS {part} LOCATION {place}")
        spark.sql(f"ALTER TABLE {_name(table)} {part} SET LOCATION {place}")
    return len(days)
