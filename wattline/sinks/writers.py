"""Landing, table and partitioned writes, read-back checks (SNK-01..SNK-07)."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def land_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """SNK-01: land records as JSON lines (overwrite).

    With ``partition_by`` the rows are rebalanced by it first, so a task
    writes few folders and a hot value is split over several tasks.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite") \
            .option("partitionOverwriteMode", "static").partitionBy(*partition_by).json(path)
    else:
        df.write.mode("overwrite").json(path)
    return path


def _name(qualified: str) -> str:
    """A dotted name with every part quoted."""
    return ".".join(f"`{part.strip('`').replace('`', '``')}`" for part in qualified.split("."))


def _text(value: str) -> str:
    """A SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def create_namespace(spark: SparkSession, name: str, location: str | None = None) -> None:
    """SNK-04: create the namespace if missing."""
    loc = f" LOCATION {_text(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_name(name)}{loc}")


def recreate_table(spark: SparkSession, qualified: str, ddl: str, location: str | None = None) -> None:
    """SNK-05: drop and create an empty typed Parquet table.

    Without ``location`` the table is managed (inside the namespace's
    folder) and dropping it deletes its data.  With ``location`` the table
    is external, so the folder is first emptied by an overwrite of zero
    rows; otherwise the new table would show the old files.
    """
    table = _name(qualified)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    if location is None:
        spark.sql(f"CREATE TABLE {table} ({ddl}) USING parquet")
        return
    spark.createDataFrame([], ddl).write.mode("overwrite").parquet(location)
    spark.sql(f"CREATE TABLE {table} ({ddl}) USING parquet LOCATION {_text(location)}")


def append_table(df: DataFrame, qualified: str) -> None:
    """SNK-02: append, matching columns by name (case-insensitive); both sides must have the same columns."""
    target = df.sparkSession.table(qualified).columns
    by_lower = {c.lower(): c for c in df.columns}
    missing = [c for c in target if c.lower() not in by_lower]
    extra = sorted(set(by_lower) - {c.lower() for c in target})
    if missing or extra or len(by_lower) < len(df.columns):
        raise ValueError(f"columns of {qualified} differ: missing {missing}, not in the table {extra}")
    df.select(*[F.col(f"`{by_lower[c.lower()]}`").alias(c) for c in target]) \
        .write.mode("append").insertInto(qualified)


def overwrite_partitioned(df: DataFrame, path: str, partition_by: list[str], sort_by: Sequence[str] = (),
                          bloom: Sequence[str] = (), row_group_bytes: int | None = None) -> str:
    """SNK-03: overwrite a Parquet table laid out by ``partition_by``.

    A ``REBALANCE`` hint clusters rows by the partition columns, so a task
    writes few files per partition value, while AQE splits a value that
    holds a large share of the rows over several tasks (a plain
    ``repartition(cols)`` would send a hot month to one task) and merges
    small ones.  All old partitions go, whatever the session's overwrite mode.

    ``sort_by`` sorts the rows of each file by these columns, so that filters
    on them (FLT-03, FLT-04) skip row groups and pages by their bounds.
    ``bloom`` adds Bloom filters for columns of many values, which bounds
    cannot tell apart.  ``row_group_bytes`` sets the size of a row group.
    """
    out = df.hint("rebalance", *[F.col(f"`{c}`") for c in partition_by])
    if sort_by:
        out = out.sortWithinPartitions(*[f"`{c}`" for c in [*partition_by, *sort_by]])
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
    return path


def overwrite_partitioned_counted(df: DataFrame, path: str, partition_by: list[str], sort_by: Sequence[str] = ()) -> int:
    """SNK-03 that also returns the number of rows written.

    The count is an observed metric of the write job itself (no second pass
    over the source); retried tasks are counted once.
    """
    obs = Observation("written")
    overwrite_partitioned(df.observe(obs, F.count(F.lit(1)).alias("rows")), path, partition_by, sort_by)
    try:
        return int(obs.get["rows"])
    except (AssertionError, Py4JError):
        # The planner drops the metric's node when it finds the input empty while running.
        if df.isEmpty():
            return 0
        raise


def key_is_unique(df: DataFrame, key: str) -> DataFrame:
    """SNK-05 key check: one row ``(n_rows, n_keys, unique)``.

    Exact: every key crosses one shuffle (unique keys cannot be combined before it).
    """
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct(key).alias("n_keys")) \
        .withColumn("unique", F.col("n_rows") == F.col("n_keys"))


def same_schema(expected: StructType, actual: StructType) -> bool:
    """Same column names and types, in any order; nullability is ignored
    (Parquet does not keep NOT NULL, and partition columns move to the end)."""
    def norm(s: StructType) -> dict[str, str]:
        return {f.name.lower(): f.dataType.simpleString() for f in s.fields}
    return norm(expected) == norm(actual)


def read_back_check(written_rows: int, read_back: DataFrame,
                    expected_schema: StructType | None = None) -> DataFrame:
    """SNK-06: one row ``(written, read_back, match, schema_match)`` for a finished write.

    The schema test runs at plan time; the count is one aggregate over the
    read-back table.
    """
    schema_ok = expected_schema is None or same_schema(expected_schema, read_back.schema)
    return read_back.agg(F.count(F.lit(1)).alias("read_back")) \
        .select(F.lit(written_rows).cast("long").alias("written"), "read_back",
                (F.col("read_back") == F.lit(written_rows)).alias("match"),
                F.lit(schema_ok).alias("schema_match"))


def to_driver(df: DataFrame):
    """SNK-07: bring a reduced result to the driver as pandas.

    A contract, not a check: the caller has aggregated ``df`` to display size
    first.  The plan runs once and nothing is cut.
    """
    return df.toPandas()
