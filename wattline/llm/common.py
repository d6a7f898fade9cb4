"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column | str) -> Column:
    """Lower-case A-Z only; other letters stay as they are.  Pure ASCII texts take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)) \
        .otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Catalyst substitutes a column that a lambda refers to, so an expensive
    expression inside ``transform`` would run once per element.  A lambda
    variable is bound once.
    """
    return F.transform(F.array(value), body)[0]


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: it does so only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def nested(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` as one struct column ``row`` next to ``columns``, so that no input column can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in columns.items()])


def unnested(rows: DataFrame) -> DataFrame:
    """The input rows of ``nested``."""
    return rows.select("row.*")


#: Bits of the filter below: 4 MB in every task, whatever the input.
FILTER_BITS = 1 << 25


def may_hold(keys: DataFrame) -> Callable[[Column], Column]:
    """A test of 64-bit hashes that holds for all ``keys(h)``, and for few others while these are few.

    The filter has a fixed size.  It thins out rows before an exact join, so
    that wide rows without a partner are not shuffled; with very many keys it
    lets all rows through and only the join decides.
    """
    place = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    words = keys.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, CAST(pmod(h, {FILTER_BITS}) & 63 AS INT))").alias("b")) \
        .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        at = h.to_numpy(dtype=np.int64) % FILTER_BITS
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)
    return test


def _with_low(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges(u, v)`` with ``low(u, m)`` joined on.

    The hash of the key is a join key too, so both sides are shuffled for
    the join alone and adaptive execution can split a hub's edges.
    """
    return edges.withColumn("h", F.xxhash64("u")).join(low.withColumn("h", F.xxhash64("u")), ["u", "h"])


def _fixed(edges: DataFrame) -> tuple:
    """Number and checksum of the edges, from what is stored."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def min_labels(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs, a <> b): one row ``(node, label)`` per node.

    ``label`` is the smallest node of the component.  Alternating star
    contraction: each round links the larger neighbours of every node to the
    smallest of it and its neighbours (large star), then a node and its
    smaller neighbours to the smallest of these (small star).  The edge count
    never grows and the number of rounds is logarithmic in practice.  Both
    steps are a two-phase minimum and a join on the node, so no neighbourhood
    is ever collected; each step is written to the shared folder.
    """
    cur = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-e")
    mark, step = _fixed(cur), 0
    while True:
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = materialise(_with_low(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .distinct(), f"{name}-l{step}")
        # Unchanged edges are stars around the smallest nodes.
        if _fixed(large) == mark:
            break
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_low(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionAll(low.select("u", F.col("m").alias("v")))
        cur, step = materialise(small.filter("u <> v").distinct(), f"{name}-s{step}"), step + 1
        mark = _fixed(cur)
    centres = cur.select(F.col("v").alias("node")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("label")) \
        .unionAll(centres.select("node", F.col("node").alias("label")))


#: Copies of one small group row, so that a group holding a third of all rows meets as many join tasks.
SALTS = 16


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """Left join of ``groups`` (few rows, unique ``keys``) onto ``rows``, hot keys spread over ``SALTS`` tasks."""
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")) \
        .join(salted, keys + ["_salt"], "left").drop("_salt")


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 by ``order`` among the rows of equal ``keys`` (not NULL), and ``size``, their number.

    A range-partitioned sort, so a key of any size is spread over tasks; a
    row's place is its place in its partition's run of the key plus the rows
    of the key in earlier partitions.  ``order`` should tell rows apart.  The
    sorted rows are written to the shared folder.
    """
    spread = materialise(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
                         .withColumn("_at", F.monotonically_increasing_id()), name) \
        .withColumn("_part", F.shiftright("_at", 33))
    runs = spread.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*keys)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(
        own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("size", F.sum("_n").over(own)).drop("_n")
    return spread.join(runs, [*keys, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")) \
        .select(*rows.columns, "pos", "size")
