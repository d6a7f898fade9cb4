"""Loads that become visible after their checks, with reserved ids and a summary kept up to date (SNK-02/05/06, PRJ-03, CCH-01).

A table is partitioned by load.  A load is written to a folder of its own,
checked there, and shown by one catalog step that adds the folder as a
partition; a load that fails a check leaves the table as it was.  Ids come
from ranges that a ledger hands out, one per load, so ids of different loads
cannot meet and no stored id is read again.  Every load also stores its sums
per key; sums of sums serve summaries of the table without its rows.

One writer at a time per table: two that reserve at once could get one range.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.sinks.writers import _name, _text

LOAD = "load"
LEDGER = "load STRING, first BIGINT, rows BIGINT"


class LoadError(RuntimeError):
    """A staged load that failed its checks; nothing of it is visible."""


def create_load_table(spark: SparkSession, table: str, ddl: str, folder: str, keys: list[str], value: str) -> None:
    """SNK-05: an empty table ``table`` (``ddl`` without the load) and its sums ``<table>_sums`` per ``keys``; both by load."""
    types = dict(spark.createDataFrame([], ddl).agg(F.sum(value).alias(value)).dtypes)
    columns = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], ddl).schema}
    sums = ", ".join(f"`{k}` {columns[k]}" for k in keys) + f", `{value}` {types[value]}, n BIGINT"
    for name, kind in ((table, ddl), (f"{table}_sums", sums)):
        spark.sql(f"DROP TABLE IF EXISTS {_name(name)}")
        spark.sql(f"CREATE TABLE {_name(name)} ({kind}, {LOAD} STRING) USING parquet PARTITIONED BY ({LOAD}) "
                  f"LOCATION {_text(f'{folder}/{name}')}")
    spark.createDataFrame([], LEDGER).write.mode("overwrite").parquet(f"{folder}/ledger")


def loads_of(spark: SparkSession, table: str) -> list[str]:
    """Loads that are visible, from the catalog alone."""
    return [unquote(r["partition"].split("=", 1)[1]) for r in spark.sql(f"SHOW PARTITIONS {_name(table)}").collect()]


def reserve_ids(spark: SparkSession, folder: str, load: str, rows: int) -> int:
    """PRJ-03: the first of ``rows`` ids that no other load has or had, recorded before it is returned.

    The ledger has one row per reservation, so its size follows the number of
    loads.  A load that failed and comes again gets a new range; the old one
    stays unused.
    """
    ledger = spark.read.schema(LEDGER).parquet(f"{folder}/ledger")
    first = ledger.agg(F.max(F.col("first") + F.col("rows"))).first()[0] or 0
    spark.createDataFrame([(load, first, rows)], LEDGER).coalesce(1).write.mode("append").parquet(f"{folder}/ledger")
    return int(first)


def _numbered(spark: SparkSession, df: DataFrame, staged: str, folder: str, load: str, id_col: str) -> tuple[DataFrame, int, int]:
    """``df``, written to ``staged``, with dense ids; the first id and the number of rows.

    Ids follow the staged files: rows are counted per writing task, and a
    task's ids begin after those of the tasks before it; the list of tasks is
    small enough to be broadcast, so rows are not shuffled.
    """
    df.withColumn("_at", F.monotonically_increasing_id()).write.parquet(staged)
    rows = spark.read.parquet(staged).withColumn("_part", F.shiftright("_at", 33))
    # One row per task of the write.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    parts = parts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    n = int(parts.agg(F.sum("_n")).first()[0] or 0)
    first = reserve_ids(spark, folder, load, n)
    given = rows.join(parts.select("_part", "_low", "_base"), "_part").withColumn(
        id_col, F.lit(first).cast("long") + F.col("_base") + F.col("_at") - F.col("_low"))
    return given.drop("_at", "_part", "_low", "_base"), first, n


def check_staged(staged: DataFrame, id_col: str, first: int, rows: int) -> None:
    """SNK-05/06: raise ``LoadError`` unless a staged load has ``rows`` rows and as many ids, all in its reserved range.

    Ranges are disjoint, so ids that are unique in the load and in its range
    are unique in the table.
    """
    got = staged.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("ids"),
                     F.min(id_col).alias("low"), F.max(id_col).alias("high")).first()
    if got["n"] != rows:
        raise LoadError(f"{got['n']} rows staged, {rows} expected")
    if got["ids"] != rows:
        raise LoadError(f"{got['ids']} ids for {rows} rows")
    if rows and not first <= got["low"] <= got["high"] < first + rows:
        raise LoadError(f"ids {got['low']} to {got['high']} outside of the reserved {first} to {first + rows - 1}")


def _show(spark: SparkSession, table: str, load: str, path: str) -> None:
    part = f"PARTITION ({LOAD} = {_text(load)})"
    spark.sql(f"ALTER TABLE {_name(table)} ADD {part} LOCATION {_text(path)}")


def publish_load(spark: SparkSession, df: DataFrame, table: str, load: str, folder: str, keys: list[str], value: str,
                 id_col: str = "ind") -> bool:
    """Add ``df`` to ``table`` as ``load``; False, and nothing done, if that load is there already.

    Steps: stage the rows, reserve ids for them, write them with their ids,
    check what was written, store the load's sums per ``keys``, then show
    sums and rows.  Rows that bring an ``id_col`` of their own keep it and
    must lie in the range reserved for them.  The rows are visible at once or
    not at all; sums of a load whose rows are not visible do not count.
    """
    if load in loads_of(spark, table):
        return False
    schema = spark.table(table).drop(LOAD).schema
    # Every attempt has folders of its own, so what a failed one left does not matter.
    at = f"{folder}/attempts/{uuid.uuid4().hex}"
    if id_col in df.columns:
        rows, n = df, df.count()
        first = reserve_ids(spark, folder, load, n)
    else:
        rows, first, n = _numbered(spark, df, f"{at}/raw", folder, load, id_col)
    by_lower = {c.lower(): c for c in rows.columns}
    if sorted(by_lower) != sorted(f.name.lower() for f in schema):
        raise LoadError(f"columns of {table} differ: {sorted(by_lower)}")
    rows.select(*[F.col(f"`{by_lower[f.name.lower()]}`").cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{at}/rows")
    staged = spark.read.schema(schema).parquet(f"{at}/rows")
    check_staged(staged, id_col, first, n)
    staged.groupBy(*keys).agg(F.sum(value).alias(value), F.count(value).alias("n")).write.parquet(f"{at}/sums")
    spark.sql(f"ALTER TABLE {_name(f'{table}_sums')} DROP IF EXISTS PARTITION ({LOAD} = {_text(load)})")
    _show(spark, f"{table}_sums", load, f"{at}/sums")
    _show(spark, table, load, f"{at}/rows")
    return True


def load_sums(spark: SparkSession, table: str) -> DataFrame:
    """CCH-01: sums per load and key of all visible loads, to be summed again; no row of the table is read."""
    seen = loads_of(spark, table)
    sums = spark.table(f"{table}_sums")
    return sums.filter(F.col(LOAD).isin(seen)) if seen else sums.limit(0)
