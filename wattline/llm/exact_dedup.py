"""Exact deduplication by deterministic block naming (operator 5).

Every normalised text is cut into fixed-size byte blocks.  The distinct
blocks are sorted and each gets an integer name; then adjacent names are
paired and the pairs are named in the same way, level by level, until each
document has one name.

A name is two integers: the 64-bit hash of the content, and the rank of the
content among the sorted distinct contents with that hash.  The rank makes it
free of collisions, so two documents end with the same name exactly when
their texts are equal, and the name is a function of the set of contents
alone: a retried task gives the same names.  Only contents whose hash is
shared (normally none) have to be looked up again; all others have rank 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import join_groups, materialise

BLOCK_BYTES = 4096
WHITE = r"[\x20\x09-\x0D]+"


def _shared_hashes(rows: DataFrame, content: list[str], label: str) -> DataFrame:
    """Sort the distinct contents; return ``(_h, content, _k)`` for those of rank over 1 or with rivals.

    ``distinct`` combines copies in each map task, so a hot block crosses the
    shuffle once per task.
    """
    same_hash = Window.partitionBy("_h")
    return materialise(
        rows.select("_h", *content).distinct()
            .withColumn("_k", F.row_number().over(same_hash.orderBy(*content)))
            .withColumn("_n", F.count(F.lit(1)).over(same_hash))
            .filter("_n > 1").drop("_n"), label)


def _named(rows: DataFrame, content: list[str], label: str) -> DataFrame:
    """Replace the ``content`` columns by the integer name ``(h, k)``."""
    keyed = rows.withColumn("_h", F.xxhash64(*content))
    rivals = _shared_hashes(keyed, content, label).toDF("_h", *[f"_c_{c}" for c in content], "_k")
    same = F.col("_h") == F.col("_rh")
    for c in content:
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    # The planner broadcasts this file if it is under the session's threshold; it is empty unless hashes collide.
    return keyed.join(rivals.withColumnRenamed("_h", "_rh"), same, "left") \
        .withColumn("h", F.col("_h")).withColumn("k", F.coalesce("_k", F.lit(1))) \
        .drop("_h", "_rh", "_k", *content, *[f"_c_{c}" for c in content])


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per distinct (id, normalised text): ``id, sha, copies, level, h, k``.

    ``sha`` is the SHA-256 of the normalised text; ``(level, h, k)`` is the
    document's identity.  A NULL text counts as empty and has one empty block.
    """
    norm = docs.select(F.col(id_col).alias("id"),
                       F.encode(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " "), "UTF-8").alias("t"))
    cut = norm.select("id", F.unhex(F.sha2("t", 256)).alias("sha"), "t",
                      F.greatest(F.ceil(F.octet_length("t") / block_bytes).cast("int"), F.lit(1)).alias("n"))
    blocks = cut.select("id", "sha", "n", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.substring(F.col("t"), i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block"))
    # Repeated rows (same id and text) fall together here; copies keeps their number.
    level0 = materialise(
        _named(blocks, ["block"], "names-rivals").groupBy("id", "sha", "n", "pos", "h", "k")
        .agg(F.count(F.lit(1)).alias("copies")), "names-0")
    done, current, level = [level0.filter("n = 1")
                            .select("id", "sha", "copies", F.lit(0).alias("level"), "h", "k")], level0.filter("n > 1"), 0
    while not current.isEmpty():
        level += 1
        pairs = current.groupBy("id", "sha", "n", (F.col("pos").bitwiseAND(F.lit(-2)) / 2).cast("int").alias("pos")).agg(
            *[F.max(F.when(F.col("pos") % 2 == side, F.col(c))).alias(f"{c}{side}") for side in (0, 1) for c in ("h", "k")],
            F.max("copies").alias("copies"))
        rows = materialise(
            _named(pairs.withColumn("n", F.ceil(F.col("n") / 2).cast("int")), ["h0", "k0", "h1", "k1"],
                   f"names-rivals-{level}"), f"names-{level}")
        done.append(rows.filter("n = 1").select("id", "sha", "copies", F.lit(level).alias("level"), "h", "k"))
        current = rows.filter("n > 1")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after every run of ASCII white space is
    one space.  Of equal texts the row with the smallest id stays; of several
    rows with that same id exactly one is kept; a NULL id loses to any other
    and, where all ids are NULL, one row is kept with a NULL ``keep_id``.
    An empty input gives no rows; other columns of ``docs`` are ignored.
    """
    ids = name_documents(docs, id_col, text_col, block_bytes)
    key = ["level", "h", "k"]
    groups = ids.groupBy(*key).agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size"),
                                   F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").drop("_rows")
    joined = join_groups(ids, groups, key, F.col("id")).select(
        "id", "copies", F.coalesce("group_size", "copies").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.lower(F.hex("sha")).alias("text_sha256"))
    stays = F.col("keep_id").eqNullSafe(F.col("id"))
    return joined.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        F.explode(F.transform(F.sequence(F.lit(1), F.col("copies")), lambda i: (i == 1) & stays)).alias("kept"),
        "text_sha256")
