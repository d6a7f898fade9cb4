"""Landed payloads to a stored table and a curated, month-partitioned collection.

One DataFrame lineage per step, nothing held on the driver: flatten the
landed responses, lower-case the names and add row ids, append to a typed
table, keep the four curated columns, write them partitioned by the year
and month of the local time text, then check what was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.timeops import text_part
from wattline.operators.ingest import flatten_hourly, largest_id, lower_case_columns, with_row_id
from wattline.operators.reshape import keep_columns
from wattline.session import scratch_path
from wattline.sinks import writers as S
from wattline.sinks.loads import LoadError
from wattline.sources.files import read_landed_payloads
from wattline.sources.schemas import CURATED_COLUMNS, STORED_TABLE_DDL
from wattline.sources.tables import read_table


def with_text_month(df: DataFrame, text_col: str = "starttime") -> DataFrame:
    """Partition columns ``year``/``month`` from the local time text (FN-05), as integers."""
    return (df.withColumn("year", text_part(text_col, 1, 4).try_cast("int"))
              .withColumn("month", text_part(text_col, 6, 2).try_cast("int")))


def check_new_ids(staged: DataFrame, id_col: str, last: int | None) -> None:
    """SNK-05: raise ``LoadError`` unless a staged load's ids are unique, not NULL and above ``last``, the table's largest.

    Ids above all of the table's cannot meet one of them, so only the load is checked.
    """
    got = staged.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("ids"), F.min(id_col).alias("low")).first()
    if got["ids"] != got["n"]:
        raise LoadError(f"{got['ids']} ids for {got['n']} rows")
    if last is not None and got["n"] and got["low"] <= last:
        raise LoadError(f"id {got['low']} is not above {last}, the table's largest")


def load_and_curate(spark: SparkSession, landing_dir: str, table: str, table_location: str,
                    curated_dir: str, multi_line: bool = True,
                    namespace_location: str | None = None, recreate: bool = True) -> DataFrame:
    """Run the ingest chain; returns the one-row read-back check of the curated write.

    ``table`` is ``namespace.name``; the namespace is created if missing (at
    ``namespace_location`` when given, else in the warehouse) and the table
    is recreated at ``table_location`` (``recreate=False`` appends to the one
    that is there, with ids above its largest).  The load is staged in the
    shared scratch folder and its key checked there, so a load that fails
    leaves the table as it was; a load without rows writes 0 rows.  Files of
    the curated collection are sorted by area and group.
    """
    ns = table.split(".")[0]
    S.create_namespace(spark, ns, namespace_location)
    if recreate:
        S.recreate_table(spark, table, STORED_TABLE_DDL, table_location)
    flat = lower_case_columns(flatten_hourly(read_landed_payloads(spark, landing_dir, multi_line=multi_line)))
    last, at = largest_id(read_table(spark, table)), scratch_path(spark, "staged")
    with_row_id(flat, above=last).write.parquet(at)
    staged = spark.read.schema(with_row_id(flat).schema).parquet(at)
    check_new_ids(staged, "ind", last)
    S.append_table(staged, table)
    curated = with_text_month(keep_columns(read_table(spark, table), CURATED_COLUMNS))
    written = S.overwrite_partitioned_counted(curated, curated_dir, ["year", "month"], sort_by=["pricearea", "productiongroup"])
    return S.read_back_check(written, spark.read.schema(curated.schema).parquet(curated_dir), curated.schema)


def curated_month(spark: SparkSession, curated_dir: str, year: int, month: int) -> DataFrame:
    """FLT-06 on the curated collection: the partition columns prune whole folders."""
    df = spark.read.parquet(curated_dir)
    return df.filter((F.col("year") == year) & (F.col("month") == month))
