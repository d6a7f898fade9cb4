"""Stand-in views over the driver's tables.

``events`` plays hourly production (5 event types = 5 groups, users spread
over 5 price areas); ``lineitem`` plays the wide weather series.  Every view
is a lazy projection of a Parquet scan, so filters and column pruning of
the queries on top reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.timeops import hour_floor

METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LOCAL_TEXT = "yyyy-MM-dd'T'HH:mm:ss"
OFFSET = "+01:00"


# Declared schemas of the driver tables the views read.  A declared schema
# skips the footer-reading job of schema inference on every read; a test
# checks that it equals what the files say.
TABLE_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "lineitem": ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                 "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                 "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, with its declared schema when it has one."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if name in TABLE_SCHEMAS:
        return spark.read.schema(TABLE_SCHEMAS[name]).parquet(path)
    return spark.read.parquet(path)


def production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: hourly production facts (time truncated to the hour, exact decimal quantity)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.concat(F.lit("NO"), (F.col("user_id") % 5 + 1).cast("string")).alias("pricearea"),
        F.col("event_type").alias("productiongroup"),
        hour_floor("ts").alias("starttime"),
        F.col("value").cast("decimal(18,2)").alias("quantitykwh"))


def _local_text(c) -> F.Column:
    return F.concat(F.date_format(c, LOCAL_TEXT), F.lit(OFFSET))


def production_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PT: P with the start time as local ISO text with offset, as stored.

    Every row is kept.  To exercise the malformed-input rules, one row in
    97 gets the text ``bad`` and one in 89 a NULL group (derived from the
    row id, so the view is deterministic).
    """
    p = production(spark, sf_dir)
    return p.select(
        "event_id", "pricearea",
        F.when(F.col("event_id") % 89 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("productiongroup")).alias("productiongroup"),
        F.when(F.col("event_id") % 97 == 0, F.lit("bad"))
         .otherwise(_local_text(F.col("starttime"))).alias("starttime"),
        "quantitykwh")


def production_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat API entries (camelCase, text times, double quantity) built from P."""
    p = production(spark, sf_dir)
    return p.select(
        "event_id",
        F.col("pricearea").alias("priceArea"),
        F.col("productiongroup").alias("productionGroup"),
        _local_text(F.col("starttime")).alias("startTime"),
        _local_text(F.col("starttime") + F.expr("INTERVAL 1 HOUR")).alias("endTime"),
        _local_text(F.col("starttime") + F.expr("INTERVAL 1 DAY")).alias("lastUpdatedTime"),
        F.col("quantitykwh").cast("double").alias("quantityKwh"))


def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N structs: API records ``{priceArea, attributes.productionPerGroupMbaHour[]}``.

    One record with a list of one entry per fact, made row by row.
    """
    r = production_records(spark, sf_dir)
    entry = F.struct("priceArea", "productionGroup", "startTime", "endTime",
                     "lastUpdatedTime", "quantityKwh")
    return r.select("priceArea", F.col("event_id").alias("batch"),
                    F.struct(F.array(entry).alias("productionPerGroupMbaHour")).alias("attributes"))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N: one JSON text per API record, as a response would carry it."""
    n = nested_records(spark, sf_dir)
    return n.select("batch", F.to_json(F.struct("priceArea", "attributes")).alias("payload"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W: wide series, ``time`` plus four double metrics."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_shipdate").alias("time"), *METRICS)


def weather_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W plus ``l_flat``: a constant metric with NULL rows (first line of each order)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_shipdate").alias("time"), *METRICS,
                     F.when(F.col("l_linenumber") == 1, F.lit(None).cast("double"))
                      .otherwise(F.lit(1.0)).alias("l_flat"))
