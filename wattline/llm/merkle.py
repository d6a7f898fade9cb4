"""Merkle dataset manifest (operator 13).

A row's leaf hashes its columns.  Every source has a tree over its leaves by
id, and a last tree over the sources' roots gives the root of the data set.
Trees grow in aligned blocks of ``FAN ** STEP`` nodes: a block keeps each of
its levels as one string of hex digests, parents are hashes of fixed-width
substrings, and a node's siblings are the substrings that flank it in its
run.  The blocks' top nodes are the next round's nodes.  No task holds more
than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import materialise, ranked

#: Nodes that become one parent.
FAN = 3
#: Levels that one block covers.
STEP = 5
#: Characters of a digest.
HEX = 64
#: Columns of a leaf, in their order in the hash.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_PATH = "array<struct<left:string,right:string>>"


def leaf_hash(values: list[Column]) -> Column:
    """Digest of ``values``: each as its UTF-8 length, a colon and itself, or ``-`` for NULL."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
             for v in values]
    return F.sha2(F.concat(*parts), 256)


def _parents(level: Column) -> Column:
    """The next level's string: one digest per run of ``FAN`` digests, the last run as short as it is."""
    runs = F.ceil(F.length(level) / F.lit(FAN * HEX)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(
        F.substring(level, i * (FAN * HEX) + 1, F.lit(FAN * HEX)), 256)), "")


def _siblings(levels: Column, steps: Column, place: Column) -> Column:
    """For the node at ``place`` of a block: what flanks it in its run, and its ancestors in theirs, bottom up."""
    def flanks(j: Column) -> Column:
        level, at = F.element_at(levels, j + 1), F.floor(place / F.pow(F.lit(FAN), j)).cast("int")
        first = at - F.pmod(at, F.lit(FAN))
        return F.struct(
            F.substring(level, first * HEX + 1, (at - first) * HEX).alias("left"),
            F.substring(level, (at + 1) * HEX + 1, (first + (FAN - 1) - at) * HEX).alias("right"))
    return F.transform(F.slice(F.array(*map(F.lit, range(STEP))), 1, steps), flanks)


def _blocks(nodes: DataFrame, step: int) -> DataFrame:
    """Blocks of ``nodes(tree, pos, size, hash, ...)``: ``tree, block, size, steps, members, levels``.

    ``steps`` is the number of levels above the nodes in this block: all of
    the tree's, or ``step``; ``members`` are the nodes by position.
    """
    width = FAN ** step
    rest = [c for c in nodes.columns if c not in ("tree", "pos", "size", "hash")]
    # Levels of a whole tree: the least h with FAN ** h >= size; compared, not computed by logarithm.
    height = sum((F.when(F.col("size") > FAN ** h, 1).otherwise(0) for h in range(step)), F.lit(0))
    grouped = nodes.groupBy("tree", "size", F.floor(F.col("pos") / F.lit(width)).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "hash", *rest))).alias("members"))
    first = F.array_join(F.transform("members", lambda m: m["hash"]), "")
    levels = F.aggregate(F.slice(F.array(*map(F.lit, range(step))), 1, F.col("steps")), F.array(first), lambda done, _: F.concat(
        done, F.array(_parents(F.element_at(done, -1)))))
    return grouped.withColumn("steps", height).withColumn("levels", levels)


def _grow(nodes: DataFrame, name: str, step: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round, and ``tree, hash`` of the trees' roots."""
    width, rounds, tops = FAN ** step, [], []
    while True:
        blocks = materialise(_blocks(nodes, step), f"{name}-{len(rounds)}")
        rounds.append(blocks)
        top = F.element_at("levels", -1).alias("hash")
        tops.append(blocks.filter(F.col("size") <= width).select("tree", top))
        if (blocks.agg(F.max("size")).first()[0] or 0) <= width:
            break
        nodes = blocks.filter(F.col("size") > width).select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("size") / F.lit(width)).cast("long").alias("size"), top)
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionAll(t)
    return rounds, roots


def _descend(rounds: list[DataFrame], trees: DataFrame, step: int) -> DataFrame:
    """Nodes of the first round with ``path``, their own siblings' and their ancestors', and the columns of ``trees``.

    ``trees(tree, path, ...)``: the path that follows each tree's root.  A
    block is joined with its parent's path before its nodes are unfolded, so
    paths are not shuffled node by node.
    """
    width, more, nodes = FAN ** step, [c for c in trees.columns if c not in ("tree", "path")], None
    for blocks in reversed(rounds):
        above = trees.withColumn("block", F.lit(0).cast("long")).select("tree", "block", "path", *more) \
            .join(blocks.filter(F.col("size") <= width).select("tree"), "tree", "left_semi")
        if nodes is not None:
            above = above.unionAll(nodes.select("tree", F.col("pos").alias("block"), "path", *more))
        nodes = blocks.join(above, ["tree", "block"]).select(
            "tree", "block", "steps", "levels", "path", *more, F.explode("members").alias("m"))
        place = (F.col("m.pos") - F.col("block") * width).cast("int")
        nodes = nodes.withColumn("path", F.concat(_siblings(F.col("levels"), F.col("steps"), place), F.col("path"))) \
            .select("tree", "path", *more, "m.*")
    return nodes


def manifest(docs: DataFrame, altered: Column | None = None, step: int = STEP) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, altered, subroot, root, path``.

    ``path`` holds the siblings from the leaf to the root as pairs of
    concatenated digests left and right of the own node; folding a leaf with
    it gives the root.  ``altered`` is the leaf that a row would have with
    that text in place of its own.  A NULL source is a source of its own,
    first of all; in a source, rows go by id (NULL first), then by leaf, so
    repeated rows are leaves of their own.  NULL fields count as absent,
    unlike empty ones.  An empty table has no rows.  Other columns are
    ignored.
    """
    fields = [F.col(c) for c in FIELDS]
    other = F.lit(None).cast("string") if altered is None else leaf_hash([*fields[:-1], altered])
    leaves = materialise(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash(fields).alias("hash"), other.alias("altered"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    rounds, subroots = _grow(ranked(leaves, ["tree"], ["doc_id", "hash", "row"], "merkle-ranked").drop("row"), "merkle-blocks", step)
    tops = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "hash"), ["tree"], ["source"], "merkle-sources")
    above, root = _grow(tops, "merkle-top", step)
    whole = root.select("tree", F.array().cast(NO_PATH).alias("path"), F.col("hash").alias("root"))
    trees = materialise(_descend(above, whole, step).select(
        F.col("source").alias("tree"), "path", F.col("hash").alias("subroot"), "root"), "merkle-trees")
    return _descend(rounds, trees, step).select("doc_id", F.col("hash").alias("leaf"), "altered", "subroot", "root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def audit(docs: DataFrame, step: int = STEP) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Rows whose id's crc32 is even are tampered with: their text loses its
    line feeds, and the leaf of that is folded with the siblings of the
    manifest.  A NULL id is not tampered with.  Cases as in ``manifest``.
    """
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    text = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return manifest(docs, text, step).withColumn("folded_root", fold(F.col("altered"), F.col("path"))).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
