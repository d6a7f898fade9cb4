"""Table profile: columns, types and non-null counts (AGG-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.operators.normalize import q


def profile(df: DataFrame) -> DataFrame:
    """One row per column: ``position, column, data_type, non_null, n_rows``.

    All counts come from one aggregate over one scan.
    """
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(F.col(q(c))).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column"),
                              F.lit(t).alias("data_type"), F.col(f"_c{i}").alias("non_null"))
                     for i, (c, t) in enumerate(df.dtypes)])
    return one.select(F.inline(rows), F.col("_n").alias("n_rows"))
