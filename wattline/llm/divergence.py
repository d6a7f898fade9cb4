"""Source divergence audit (operator 11).

How far the word use of every (language, source) group is from that of the
other sources of its language, and which words a group overuses.  Rates are
smoothed by ``ADD`` and are integers of parts in a thousand million.

The distances come by Gustavson's row accumulation.  The cells (group, term)
of a block of terms form a term-major index.  A group walks over its own
terms and scatters, through the index, into a dense accumulator with one
place per peer; no pair of postings leaves the task.  The scatter counts
terms that both have; what a term adds where only one or none has it follows
from the peers' rates of an absent term (their baselines): with every cell
that two groups share, the three baseline distances are corrected, and sorted
rates with running sums give each group's distance to any baseline.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import join_groups, materialise, ranked

#: Documents of a language that a kept term has at least.
LEAST_DOCS = 30
SCALE = 1_000_000_000
ADD = 5
#: Ranks of overused terms per group.
TOP = 50
#: Cells of one block of terms: so many per group, within these bounds; a block returns a sum for each pair of groups.
BLOCK_CELLS = (100_000, 2_000_000)
GROUP_CELLS = 200
#: Places of the accumulators that one task fills, about.
PLACES = 4_000_000
#: Distinct terms that a counting task holds before it hands them on.
HELD = 500_000
#: Bytes that end a term become blanks and A-Z lower case; other bytes, all of non-ASCII characters among them, stay.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and non-ASCII characters in UTF-8 ``text``, A-Z lower-cased."""
    return text.translate(LETTERS).split()


def tally(docs: DataFrame) -> DataFrame:
    """Partial counts ``lang, source, term, n, d``: occurrences and documents; every group has a row with a NULL term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                rows = len(n) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * rows), pa.array([source] * rows), pa.array([None, *n], pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()), pa.array([0, *(d[t] for t in n)], pa.int64())], ["lang", "source", "term", "n", "d"])
            held.clear()
        for batch in batches:
            lang, source, text = (batch.column(k) for k in range(3))
            for a, b, t in zip(lang.to_pylist(), source.to_pylist(), text.cast(pa.binary())):
                n, d = held.setdefault((a, b), (Counter(), Counter()))
                words = terms_of(t.as_py())
                n.update(words)
                d.update(set(words))
            if sum(len(n) for n, _ in held.values()) >= HELD:
                yield from hand_on()
        yield from hand_on()
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]) \
        .mapInArrow(run, "lang string, source string, term string, n long, d long")


def rate(n: Column, whole: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + ADD) / (whole + ADD * kept)), in exact decimals; 1 where nothing is kept."""
    part = (n + F.lit(ADD)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = (whole + F.lit(ADD) * kept).cast("decimal(38,0)")
    return F.when(whole == 0, F.lit(1)).otherwise(F.lit(1) + F.call_function("div", part, F.when(whole != 0, whole))).cast("long")


def scatter(cells: pd.DataFrame, first: int, stop: int) -> pd.DataFrame:
    """Distances of the groups numbered ``first`` to ``stop`` to all groups, over one block of terms: ``source, item, value``.

    ``cells`` has ``idx, term, p`` per term of a group, and for every group of
    the language (numbered from 0) a row without term, with its ``source`` and
    baseline ``p``.
    """
    base = cells[cells["term"].isna()].sort_values("idx")
    name, zero = base["source"].to_numpy(), base["p"].to_numpy(dtype=np.int64)
    groups = len(base)
    cells = cells[cells["term"].notna()]
    row = cells["idx"].to_numpy(dtype=np.int64)
    p = cells["p"].to_numpy(dtype=np.int64)
    term = pd.factorize(cells["term"])[0].astype(np.int64)
    terms = int(term.max()) + 1 if len(term) else 0
    has = np.bincount(row, minlength=groups)
    # Term-major index, and the rows' own cells.
    by_term = np.lexsort((row, term))
    peer, peer_p = row[by_term], p[by_term]
    length = np.bincount(term, minlength=terms)
    head = np.cumsum(length) - length
    by_row = np.lexsort((term, row))
    own_term, own_p = term[by_row], p[by_row]
    edge = np.concatenate((np.zeros(1, np.int64), np.cumsum(has)))
    # Rates of each group in order, with running sums, for distances to a baseline.
    key = np.sort(row * (SCALE * 2) + p)
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(key % (SCALE * 2))))

    def to_baseline(group: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Sum of the distances of the groups' rates to ``z``."""
        at = np.searchsorted(key, group * (SCALE * 2) + z, side="right")
        lo, hi = edge[group], edge[group + 1]
        return (total[hi] - total[at]) - (hi - at) * z + (at - lo) * z - (total[at] - total[lo])
    everyone, out = np.arange(groups), []
    for i in range(first, min(stop, groups)):
        mine = slice(edge[i], edge[i + 1])
        reach = length[own_term[mine]]
        at = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(head[own_term[mine]], reach)
        j, q, x = peer[at], peer_p[at], np.repeat(own_p[mine], reach)
        near = np.abs(zero[i] - zero)
        value = np.zeros(groups, dtype=np.int64)
        # A shared term counts by its rates; what the sums below add for it is taken off.
        np.add.at(value, j, np.abs(x - q) - np.abs(x - zero[j]) - np.abs(q - zero[i]) + near[j])
        value += to_baseline(np.full(groups, i), zero) + to_baseline(everyone, np.full(groups, zero[i])) + near * (terms - has[i] - has)
        others = everyone != i
        out.append(pd.DataFrame({"source": name[i], "item": name[others], "value": value[others]}))
    return pd.concat(out) if out else pd.DataFrame({"source": [], "item": [], "value": np.zeros(0, np.int64)})


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block_cells: tuple[int, int] = BLOCK_CELLS,
               places: int = PLACES) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group: part ``pair`` and part ``term``.

    ``pair`` has the distance to each other source of the language over all
    kept terms, ``term`` the ``top`` terms that the group has more often than
    the language as a whole.  Ranks go by value, largest first, then item in
    byte order.  A NULL language, source or text counts as empty; groups
    without terms have pairs too; a language without kept terms has distances
    of 0; a language of one source has no pairs.  Repeated rows count each.
    An empty table gives no rows.  Other columns are ignored.
    """
    counts = materialise(tally(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "divergence-counts")
    some = counts.filter(F.col("term").isNotNull())
    kept = materialise(some.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("d").alias("docs"))
                       .filter(F.col("docs") >= least_docs).select("lang", "term", "all"), "divergence-terms")
    cells = materialise(some.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all"), "divergence-cells")
    # One row per group, numbered within its language; one row per language.
    whole = counts.filter(F.col("term").isNull()).select("lang", "source", F.lit(0).cast("long").alias("n"), F.lit(0).alias("k")) \
        .unionAll(cells.select("lang", "source", "n", F.lit(1))).groupBy("lang", "source").agg(
        F.sum("n").alias("whole"), F.sum("k").cast("long").alias("cells"))
    groups = ranked(whole, ["lang"], ["source"], "divergence-groups")
    langs = groups.groupBy("lang").agg(F.sum("whole").alias("lang_whole"), F.sum("cells").alias("cells"), F.max("size").alias("groups")) \
        .join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left").na.fill(0, ["kept"])
    stats = materialise(groups.select("lang", "source", "whole", F.col("pos").alias("idx")).join(langs, "lang"), "divergence-stats")
    rated = materialise(join_groups(cells, stats, ["lang", "source"], F.col("term")).select(
        "lang", "source", "idx", "term", rate(F.col("n"), F.col("whole"), F.col("kept")).alias("p"),
        rate(F.col("all"), F.col("lang_whole"), F.col("kept")).alias("q"), "cells", "groups"), "divergence-rates")
    # Blocks of terms, each handed to all blocks of rows of its language.
    held = F.least(F.greatest(F.col("groups") * GROUP_CELLS, F.lit(block_cells[0])), F.lit(block_cells[1]))
    blocks = F.ceil(F.col("cells") / held).cast("long")
    rows = F.greatest(F.floor(F.lit(places) / F.col("groups")), F.lit(1)).cast("long")
    last = F.floor((F.col("groups") - 1) / rows).cast("long")
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("part")
    dealt = rated.select("lang", "source", "idx", "term", "p", rows.alias("rows"), last.alias("last"),
                         F.pmod(F.xxhash64("term"), blocks).alias("block")).select("lang", "block", "rows", spread, "source", "idx", "term", "p")
    peers = stats.select("lang", "source", "idx", rate(F.lit(0), F.col("whole"), F.col("kept")).alias("p"), rows.alias("rows"), last.alias("last"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(blocks, F.lit(1)) - 1)).alias("block")) \
        .select("lang", "block", "rows", spread, "source", "idx", F.lit(None).cast("string").alias("term"), "p")

    def accumulate(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        size = int(block["rows"].iloc[0])
        out = scatter(block, int(key[2]) * size, (int(key[2]) + 1) * size)
        out.insert(0, "lang", key[0])
        return out
    pairs = dealt.unionAll(peers).groupBy("lang", "block", "part").applyInPandas(
        accumulate, "lang string, source string, item string, value long") \
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    over = rated.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                        (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionAll(over.withColumn("rank", place).filter(F.col("rank") <= top))
