"""Sharding by vector bin packing (operator 3).

Bytes, tokens and rows are balanced jointly.  Documents with equal texts form
a group that stays together.  Groups are gathered into a fixed number of
bundles by the hash of their text; a group too large for a bundle is placed
on its own.  The bundles and large groups, whose number has a fixed bound,
are placed one by one, largest first, each into the shard where the dot
product of its vector with the shard's residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import materialise
from wattline.llm.mixing import tokens

SHARDS = 16
#: Bundles per run; with the groups above one bundle's mean (at most this many per measure) the packing
#: list has at most (1 + 3) * BUNDLES + pieces rows, whatever the input.
BUNDLES = 4096
#: A group above this share of one shard's capacity is cut into pieces, since no shard could hold it evenly.
PIECE = 0.5
#: Rows that one slot-numbering task handles, on average.
SLOT_ROWS = 200_000
MEASURES = ("size", "tokens", "rows")
#: The law is `bytes`, so bytes weigh most in the dot product.
WEIGHTS = np.array([1.0, 0.3, 0.3])


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of ``vectors`` (items x measures, each measure's total scaled to ``shards``).

    Most bytes first.  Each goes to the shard with the highest dot product of
    its vector with the residual capacity, measures weighted by ``WEIGHTS``;
    ties go to the lower shard.
    """
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int32)
    for i in np.argsort(-vectors[:, 0], kind="stable"):
        at = int(np.argmax(left @ (vectors[i] * WEIGHTS)))
        out[i], left[at] = at, left[at] - vectors[i]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``bytes``: shards' byte sums are near equal, and their token
    and row counts as near as the same placement allows.  ``size`` is the
    text's UTF-8 length plus 1; a NULL text counts as empty and forms one
    group with empty texts.  Equal texts share a shard unless together they
    exceed ``PIECE`` of one shard; then the group is cut by the hash of the
    id.  ``slot`` numbers a shard's rows from 0 in the order of (segment of
    the id's hash, id); repeated ids get slots of their own.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), tokens(F.col(text_col)).alias("tokens"),
        F.lit(1).cast("long").alias("rows"), F.xxhash64(text).alias("group")), "shard-rows")
    sums = [F.sum(m).alias(m) for m in MEASURES]
    whole = rows.agg(*sums).first()
    total = {m: max(int(whole[m] or 0), 1) for m in MEASURES}
    share = F.greatest(*[F.col(m) / F.lit(total[m]) for m in MEASURES])
    groups = rows.groupBy("group").agg(*sums).withColumn("share", share)
    # At most `bundles` groups per measure can be above the mean bundle.
    large = materialise(groups.filter(F.col("share") > 1.0 / bundles).withColumn(
        "pieces", F.ceil(F.col("share") * (shards / PIECE)).cast("int")).withColumn(
        "pieces", F.when(F.col("share") * shards > PIECE, F.col("pieces")).otherwise(1)), "shard-large")
    # The broadcasts below are bounded by the same count.
    keyed = rows.join(F.broadcast(large.select("group", "pieces")), "group", "left").withColumn(
        "item", F.when(F.col("pieces").isNull(), F.pmod("group", F.lit(bundles)))
        .otherwise(F.xxhash64("group", F.pmod(F.xxhash64("doc_id"), F.coalesce("pieces", F.lit(1)).cast("long"))))) \
        .withColumn("single", F.col("pieces").isNotNull())
    items = keyed.groupBy("item", "single").agg(*sums).orderBy("item", "single").collect()
    vectors = np.array([[r[m] / total[m] * shards for m in MEASURES] for r in items]).reshape(-1, len(MEASURES))
    placed = [(r["item"], r["single"], int(s)) for r, s in zip(items, pack(vectors, shards))]
    places = spark.createDataFrame(placed, "item long, single boolean, shard int")
    # Slots: count per (shard, segment), offsets over the few segments of a shard, then ranks within a segment.
    segments = max(1, -(-total["rows"] // (SLOT_ROWS * shards)))
    located = materialise(keyed.join(F.broadcast(places), ["item", "single"]).select(
        "doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(segments)).alias("segment")),
        "shard-placed")
    return located.transform(_slots).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def _slots(located: DataFrame) -> DataFrame:
    counts = located.groupBy("shard", "segment").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("offset", F.sum("n").over(
        Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))) \
        .select("shard", "segment", F.coalesce("offset", F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "segment").orderBy("doc_id", "text_crc32", "size"))
    return located.join(before, ["shard", "segment"]).withColumn("slot", (F.col("offset") + rank - 1).cast("long"))
