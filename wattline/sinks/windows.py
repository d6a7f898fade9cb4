"""Ledger of the windows a load planned, tried and landed (GEN-01/S14), updated in place.

One small row per (key, window), stored in a partition of its own.  An
update writes the partitions of the windows it names (dynamic partition
overwrite) and leaves all others alone, so what is still to be fetched is
read off the ledger and no fact is scanned.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLANNED, LANDED, FAILED, REFUSED = "planned", "landed", "failed", "refused"
STATES = (LANDED, FAILED, REFUSED)
_FACTS = [T.StructField("state", T.StringType()), T.StructField("tries", T.IntegerType()), T.StructField("rows", T.LongType())]


def _schema(key: str) -> T.StructType:
    return T.StructType([*_FACTS, T.StructField(key, T.StringType()), T.StructField("window_start", T.DateType())])


def _write(df: DataFrame, path: str, key: str) -> None:
    (df.select("state", "tries", "rows", key, "window_start").coalesce(1).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(key, "window_start").parquet(path))


def create_ledger(spark: SparkSession, path: str, key: str) -> None:
    """An empty ledger; a folder that is there is emptied."""
    spark.createDataFrame([], _schema(key)).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def read_ledger(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Columns: key, ``window_start``, ``state``, ``tries``, ``rows`` (of the last landing)."""
    return spark.read.schema(_schema(key)).parquet(path).select(key, "window_start", "state", "tries", "rows")


def plan_windows(spark: SparkSession, path: str, windows: DataFrame, key: str) -> None:
    """Add the (key, window) pairs the ledger does not know, as planned; those it knows stay as they are.

    ``windows`` comes from ``month_windows``; a NULL key is a key.
    """
    # Without keys a file's values are read from its folder, so the join meets whole rows.
    known = read_ledger(spark, path, key).select(F.col(key).alias("_k"), F.col("window_start").alias("_w"))
    new = windows.select(F.col(key).cast("string").alias(key), F.col("window_start").cast("date").alias("window_start")).distinct()
    new = new.join(known, F.col(key).eqNullSafe(F.col("_k")) & (F.col("window_start") == F.col("_w")), "left_anti")
    _write(new.withColumns({"state": F.lit(PLANNED), "tries": F.lit(0), "rows": F.lit(0).cast("long")}), path, key)


def record_tries(spark: SparkSession, path: str, outcomes: DataFrame, key: str) -> None:
    """Count one try of each window in ``outcomes`` (key, ``window_start``, ``state``, ``rows``).

    ``state`` is landed, failed (may be tried again) or refused (a request
    the server will not answer, not tried again).  A window that landed
    stays landed, with the rows of its last landing, whatever later tries
    bring.  Fails, and changes nothing, on a window that was not planned, is
    named twice, or has another state.
    """
    now = outcomes.groupBy(F.col(key).cast("string").alias("_k"), F.col("window_start").cast("date").alias("_w")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("state").alias("_state"), F.max("rows").cast("long").alias("_rows"))
    led = read_ledger(spark, path, key)
    both = now.join(led, F.col(key).eqNullSafe(F.col("_k")) & (F.col("window_start") == F.col("_w")), "left")
    message = (F.when(F.col("state").isNull(), F.lit("not planned: ")).when(F.col("_n") > 1, F.lit("named twice: "))
               .when(~F.coalesce(F.col("_state").isin(*STATES), F.lit(False)), F.lit("unknown state: ")))
    name = F.concat_ws(" ", F.col("_k"), F.col("_w").cast("string"), F.col("_state"))
    landed = F.col("_state") == LANDED
    state = F.when(message.isNotNull(), F.raise_error(F.concat(message, name)).cast("string")) \
        .when((F.col("state") == LANDED) | landed, F.lit(LANDED)).otherwise(F.col("_state"))
    done = both.select(F.col("_k").alias(key), F.col("_w").alias("window_start"), state.alias("state"),
                       (F.col("tries") + 1).alias("tries"), F.when(landed, F.coalesce("_rows", F.lit(0))).otherwise(F.col("rows")).alias("rows"))
    _write(done, path, key)


def to_fetch(ledger: DataFrame, most_tries: int | None = None) -> DataFrame:
    """Windows still to be fetched: planned, or failed fewer than ``most_tries`` times."""
    open_ = F.col("state").isin(PLANNED, FAILED)
    return ledger.filter(open_ if most_tries is None else open_ & (F.col("tries") < most_tries))
