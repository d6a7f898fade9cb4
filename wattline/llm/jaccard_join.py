"""N-gram Jaccard join by T-occurrence search with DivideSkip (operator 6).

A document's set is its distinct five-word shingles, as 64-bit hashes.
Documents with equal sets fall into one class first; the join runs between
classes.

1. Every task reports the shingles that repeat within it; the most frequent
   ones of the corpus are the long lists.  They come last in the shingle order.
2. A class lists only its first ``n - T + c`` shingles in that order, where
   ``T`` is the least overlap of a link and ``c`` a tenth of n: linked classes
   share c of these at least.  Equal shingles meet in one hash bucket.  Short
   lists are merged by counting, and pairs that reach c over all buckets are
   candidates.  A list above ``SHORT_LIST`` classes only chains its members,
   so m classes give at most m - 1 edges; a pair that meets in such a list is
   a candidate without a count.  So is one that also has a mark of near copies
   in common; pairs that such edges connect in a bucket are not counted in it.
3. The components of these edges bound the search.  A passage in many texts
   may chain unlinked classes to a large one: the sets of these meet in parts,
   and the links of parts bound it again.  Within each, the inverted
   lists are built in full and every class is searched: the lists are divided,
   the short ones are merged by counting, and for the candidates that can
   still reach T the long ones are probed by binary search.

Exact overlaps decide; components of the links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import join_groups, materialise, may_hold, min_labels, nested, release, unnested

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: At most this many shingles count as long lists: 16 bytes each in every task.
LONG_LISTS = 1 << 18
#: Shingles that a task holds before it reports repeats; prefix entries of one bucket; shingles of one search tile.
TASK_SHINGLES = 4_000_000
#: Lists up to this length are merged pair by pair; longer ones are chained.
SHORT_LIST = 16
BUCKET_ENTRIES = 2_000_000
#: Prefix entries that a task deals out at a time.
TASK_ENTRIES = 500_000
TILE_SHINGLES = 2_000_000
PIECE = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240101))
#: One random value per byte; A-Z share those of a-z.
BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
BASE = int(_RNG.integers(0, 1 << 63)) * 2 + 1
PLACE = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHORT = _RNG.integers(0, 1 << 64, SHINGLE, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``n``."""
    got = _powers.get(name)
    if got is None or len(got) < n:
        got = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        got[0] = 1
        _powers[name] = got = np.cumprod(got, dtype=np.uint64)
    return got[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the white-space words of ``text``, A-Z lower-cased, in order."""
    out, at, n = [], 0, len(text)
    buffer = np.frombuffer(text, dtype=np.uint8)
    while at < n:
        stop = min(at + PIECE, n)
        if stop < n:  # cut at white space, so that no word is cut
            gaps = np.flatnonzero(WHITE[buffer[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(WHITE[buffer[stop:]])
                stop = stop + int(rest[0]) + 1 if len(rest) else n
        b = buffer[at:stop]
        at = stop
        edge = np.flatnonzero(np.diff(np.concatenate(([True], WHITE[b], [True])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[b] * _power("up", BASE, len(b)), dtype=np.uint64)))
        out.append(_mix((sums[ends] - sums[starts]) * _power("down", pow(BASE, -1, 1 << 64), len(b) + 1)[starts]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _raw(texts: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each text where they lie; none for NULL."""
    held = texts.cast(pa.large_binary()).fill_null(b"")
    if len(held):
        _, stops, data = held.buffers()
        view = memoryview(data or b"")
        for a, b in pairwise(np.frombuffer(stops, dtype=np.int64)[held.offset:held.offset + len(held) + 1].tolist()):
            yield view[a:b]


def shingles(text: str | bytes | memoryview | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text or its UTF-8 bytes; one of fewer words is one shingle, one without words has none."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass") if text is None or isinstance(text, str) else text)
    if not len(w):
        return w
    if len(w) < SHINGLE:
        return _mix((w * PLACE[:len(w)]).sum(dtype=np.uint64, keepdims=True) + SHORT[len(w)])
    total = np.zeros(len(w) - SHINGLE + 1, dtype=np.uint64)
    for j in range(SHINGLE):
        total += w[j:len(w) - SHINGLE + 1 + j] * PLACE[j]
    return np.unique(_mix(total))


def signature(s: np.ndarray) -> int | None:
    """Identity of a set as a signed 64-bit integer; None for the empty set."""
    if not len(s):
        return None
    size = np.array([len(s)], dtype=np.uint64)
    return int(_mix(_mix(s).sum(dtype=np.uint64, keepdims=True) + size * PLACE[0]).view(np.int64)[0])


def least_overlap(n: int) -> int:
    """Overlap that any link of a set of ``n`` needs: ceil(PERCENT % of n)."""
    return -(-PERCENT * n // 100)


def least_shared(n: int) -> int:
    """Shingles that any link of a set of ``n`` shares within the two prefixes."""
    return max(1, min(-(-n // 10), least_overlap(n)))


#: Starts of eight equal ranges of hashes.
RANGES = np.arange(8, dtype=np.uint64) << np.uint64(61)


def alike(s: np.ndarray) -> int:
    """Two 16-bit marks of a set, each of the least hashes of four ranges: near copies mostly have one in common."""
    least = s[np.minimum(np.searchsorted(s, RANGES), len(s) - 1)].reshape(2, 4)
    one, two = (_mix((least * PLACE[:4]).sum(axis=1, dtype=np.uint64)) >> np.uint64(48)).tolist()
    return one << 16 | two


class Forest:
    """Union-find over integers below ``n``; ``add`` tells whether two trees became one."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


# ------------------------------------------------------------------ 1 sets and long lists
def _repeats(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that are in several of the ``held`` sets, and in how many; empties ``held``."""
    codes = np.concatenate([*held, np.zeros(0, np.uint64)])
    held.clear()
    codes.sort()
    again = np.concatenate(([False], codes[1:] == codes[:-1], [False]))
    first, last = np.flatnonzero(~again[:-1] & again[1:]), np.flatnonzero(again[:-1] & ~again[1:])
    return codes[first], last - first + 1


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n, sig, false, h) per document, and (NULL, count, hash, true, NULL) for shingles that repeat in this task."""
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size, names = 0, ["doc_id", "n", "sig", "hot", "h"]

    def repeats() -> pa.RecordBatch:
        codes, counts = _repeats(held)
        none = pa.nulls(len(codes), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(counts, pa.int64()), pa.array(codes.view(np.int64)),
                                           pa.array(np.ones(len(codes), dtype=bool)), none], names)
    for batch in batches:
        sizes, sigs = [], []
        for text in _raw(batch.column("text")):
            s = shingles(text)
            sig = signature(s)
            sizes.append(len(s))
            sigs.append(sig)
            if sig is not None and sig not in seen:
                seen.add(sig)
                held.append(s)
                size += len(s)
                if size >= TASK_SHINGLES:
                    yield repeats()
                    seen.clear()
                    size = 0
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()),
                                          pa.array(np.zeros(len(sizes), dtype=bool)), batch.column("h")], names)
    yield repeats()


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Object columns, so that NULL and 64-bit integers stay exact."""
    return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})


def long_lists(repeats: DataFrame, most: int = LONG_LISTS) -> tuple[np.ndarray, np.ndarray]:
    """The corpus' most frequent shingles (sorted hashes) and their counts, at most ``most``.

    Counts sum each task's repeats.  The order of shingles only steers the
    work; results do not depend on it.
    """
    sums = materialise(repeats.groupBy("sig").agg(F.sum("n").alias("n")), "jaccard-repeats")
    bins = sums.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()
    least, total = 63, 0
    for row in sorted(bins, key=lambda r: -r["b"]):
        total += row["k"]
        if total > most:
            break
        least = row["b"]
    top = sums.filter(F.floor(F.log2("n")) >= least).toPandas()
    codes = top["sig"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(codes)
    return codes[order], top["n"].to_numpy(dtype=np.int64)[order]


def prefix(s: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first ``n - T + c`` shingles of a set, long lists last and the longest of them at the end."""
    k = len(s) - least_overlap(len(s)) + least_shared(len(s))
    if not len(hot):
        return s[:k]
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    length = np.where(hot[at] == s, counts[at], 0)
    return s[np.lexsort((s, length))[:k]]


# ------------------------------------------------------------------ 2 bounded inverted lists
def _candidates(group: pd.DataFrame) -> pd.DataFrame:
    """Edges ``a, b, shared, need`` of one bucket.

    With ``need`` 0 a forest of the chains between neighbours by size in
    longer lists, and of the pairs in short lists that have one of their
    ``marks`` in common.  The other pairs of short lists that this forest does
    not connect come with the number of shingles shared here.  So a family of
    near copies gives an edge a member, not one a pair, in each bucket.
    """
    repeat = np.frombuffer(b"".join(group["repeat"]), dtype=np.uint16)
    names, at, who = np.unique(np.frombuffer(b"".join(group["sigs"]), dtype=np.int64), return_index=True, return_inverse=True)
    size = np.frombuffer(b"".join(group["sizes"]), dtype=np.uint32)[at].astype(np.int64)
    # Classes are numbered by size; an entry is one integer, its shingle before its class.
    order = np.lexsort((names, size))
    marks = np.frombuffer(b"".join(group["marks"]), dtype=np.uint32)[at][order] if "marks" in group else None
    names, size, place = names[order], size[order], np.argsort(order).astype(np.uint64)
    entry = np.frombuffer(b"".join(group["codes"]), dtype=np.uint32).astype(np.uint64)
    entry <<= np.uint64(32)
    entry |= np.repeat(place[who], repeat)
    entry.sort()
    if len(entry):  # a class may be listed by several tasks
        entry = entry[np.concatenate(([True], entry[1:] != entry[:-1]))]
    codes, who = (entry >> np.uint64(32)).astype(np.uint32), entry.astype(np.uint32)
    del entry
    same = codes[1:] == codes[:-1]
    runs = np.diff(np.concatenate(([0], np.flatnonzero(~same) + 1, [len(codes)])))
    length = np.repeat(np.minimum(runs, SHORT_LIST + 1).astype(np.uint8), runs)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs of classes of such sizes that they may link, each as one integer."""
        fit = 100 * size[x] >= PERCENT * size[y]
        return x[fit].astype(np.int64) * len(names) + y[fit]
    # Chains in the long lists.
    link = np.flatnonzero(same & (length[1:] > SHORT_LIST))
    forest, a, b = Forest(len(names)), [], []
    for pair in np.unique(near(who[link], who[link + 1])).tolist():
        x, y = divmod(pair, len(names))
        if forest.add(x, y):
            a.append(x)
            b.append(y)
    # Pairs of the short lists.
    low = np.flatnonzero((length > 1) & (length <= SHORT_LIST))
    codes, who = codes[low], who[low]
    pairs = []
    for k in range(1, SHORT_LIST):
        at = np.flatnonzero(codes[k:] == codes[:-k])
        pairs.append(near(who[at], who[at + k]))
    code, shared = np.unique(np.concatenate(pairs), return_counts=True)
    x, y = code // max(len(names), 1), code % max(len(names), 1)
    if marks is not None:
        both = marks[x] ^ marks[y]
        for i, j in zip(*(z[(both >> 16 == 0) | (both & 65535 == 0)].tolist() for z in (x, y))):
            if forest.add(i, j):
                a.append(i)
                b.append(j)
    if a:  # what the forest connects needs no count
        root = np.array([forest.find(k) for k in range(len(names))], dtype=np.int64)
        apart = root[x] != root[y]
        x, y, shared = x[apart], y[apart], shared[apart]
    need = [min(least_shared(i), least_shared(j)) for i, j in zip(size[x].tolist(), size[y].tolist())]
    return pd.DataFrame({
        "a": names[np.concatenate((np.array(a, dtype=np.int64), x))], "b": names[np.concatenate((np.array(b, dtype=np.int64), y))],
        "shared": np.concatenate((np.ones(len(a), dtype=np.int64), shared)),
        "need": np.concatenate((np.zeros(len(a), dtype=np.int64), np.array(need, dtype=np.int64)))})


# ------------------------------------------------------------------ 3 T-occurrence search
def t_occurrence(sets: list[np.ndarray], sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Spanning links between ``sets`` (positions), by DivideSkip over their inverted lists.

    With ``sides``, only pairs of different sides are compared.  Pairs whose
    sets are connected already are not compared again, so the links are a
    forest with the same components as all links.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    size = np.array([len(sets[i]) for i in order], dtype=np.int64)
    side = np.array([sides[i] if sides else 0 for i in order])
    start = np.concatenate(([0], np.cumsum(size)))
    token = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    member = np.repeat(np.arange(len(order)), size)
    # All inverted lists end to end: sorted by token, then member.
    lists = np.sort(token * len(order) + member)
    length = np.bincount(token)
    first = np.concatenate(([0], np.cumsum(length)))
    forest, out = Forest(len(order)), []
    for x in range(len(order)):
        own = token[start[x]:start[x + 1]]
        need = least_overlap(len(own))
        own = own[np.argsort(length[own], kind="stable")]
        # Divide: the longest lists, fewer than T, are only probed.
        aside = int(need / (0.05 * np.log2(max(int(length[own[-1]]), 2)) + 1))
        aside = min(aside, need - 1)
        short, rest = own[:len(own) - aside], own[len(own) - aside:]
        short = short[length[short] > 1]
        if not len(short):
            continue
        # Merge the short lists by counting.
        reach = length[short]
        flat = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(first[short], reach)
        found, count = np.unique(lists[flat] % len(order), return_counts=True)
        keep = (found > x) & (count >= need - aside)
        if sides:
            keep &= side[found] != side[x]
        found, count = found[keep], count[keep]
        keep = 100 * len(own) >= PERCENT * size[found]
        for y, c in zip(found[keep].tolist(), count[keep].tolist()):
            if forest.find(x) == forest.find(y):
                continue
            # Probe the long lists for y.
            key = rest * len(order) + y
            at = np.minimum(np.searchsorted(lists, key), len(lists) - 1)
            both = c + int((lists[at] == key).sum())
            if 100 * both >= PERCENT * (len(own) + int(size[y]) - both):
                forest.add(x, y)
                out.append((order[x], order[y]))
    return out


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Two documents link when 100 * intersection >= 75 * union of their shingle
    sets; ``component_id`` is the smallest id reachable by links.  Words are
    white-space separated, A-Z lower-cased; NULL, empty and blank texts have
    no shingles and link with nothing; repeated rows link with each other.  A
    NULL id counts as no id: its row takes the smallest other id of its
    component, or NULL.  Other columns are ignored.
    """
    return _classes(*_linked(_keyed(docs, id_col, text_col)))


def _keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` and ``h``, a hash of both."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.withColumn("h", F.xxhash64("doc_id", "text"))


def _linked(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Members ``(doc_id, n, sig, h)`` of ``rows(doc_id, text, h)``; labels ``(node, label)`` of linked sets."""
    spark = rows.sparkSession
    profile = materialise(rows.select("doc_id", "text", "h").mapInArrow(_profile, "doc_id long, n long, sig long, hot boolean, h long"), "jaccard-profile")
    members = profile.filter("not hot").drop("hot")
    shared = spark.sparkContext.broadcast(long_lists(profile.filter("hot")))
    entries = members.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-entries * (110 - PERCENT) // 100 // BUCKET_ENTRIES))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Prefix entries per bucket; a class is listed once per task."""
        seen: set[int] = set()
        codes, sigs, sizes, marks, held = [], [], [], [], 0

        def dealt() -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) for c in codes])
            code = np.concatenate(codes)
            bucket = ((code >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((owner, bucket))
            code, owner, bucket = code[order].astype(np.uint32), owner[order], bucket[order]
            sig, size, mark = np.array(sigs, dtype=np.int64), np.array(sizes, dtype=np.uint32), np.array(marks, dtype=np.uint32)
            out = []
            for lo, hi in _runs(bucket):
                runs = [(a, min(b, a + 65535)) for lo2, b in _runs(owner[lo:hi]) for a in range(lo2, b, 65535)]
                who = owner[lo:hi][[a for a, _ in runs]]
                out.append((int(bucket[lo]), code[lo:hi].tobytes(), sig[who].tobytes(), size[who].tobytes(),
                            np.array([b - a for a, b in runs], dtype=np.uint16).tobytes(), mark[who].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["bucket", "codes", "sigs", "sizes", "repeat", "marks"])
        for batch in batches:
            for text in _raw(batch.column("text")):
                s = shingles(text)
                sig = signature(s)
                if sig is None or sig in seen:
                    continue
                seen.add(sig)
                codes.append(prefix(s, *shared.value))
                sigs.append(sig)
                sizes.append(len(s))
                marks.append(alike(s))
                held += len(codes[-1])
                if held >= TASK_ENTRIES:
                    yield dealt()
                    codes, sigs, sizes, marks, held = [], [], [], [], 0
        if codes:
            yield dealt()

    lists = rows.select("text").mapInArrow(
        spread, "bucket long, codes binary, sigs binary, sizes binary, repeat binary, marks binary")
    maybe = materialise(lists.groupBy("bucket").applyInPandas(_candidates, "a long, b long, shared long, need long")
                        .groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"))
                        .filter("shared >= need").select("a", "b"), "jaccard-maybe")
    release(spark)
    if maybe.isEmpty():
        labels = None
    else:
        labels = _search(rows, members, min_labels(maybe, "jaccard-bound"))
    return members, labels


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Start and stop of each run of equal values."""
    cut = np.flatnonzero(np.diff(x)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(x)])) if len(x) else []


def _search(rows: DataFrame, members: DataFrame, bound: DataFrame) -> DataFrame:
    """``node, label`` of linked classes, searched within the components ``bound(node, label)``.

    Small components share tiles of about ``TILE_SHINGLES``.  A larger one is
    bounded again by ``_finer``; what stays large is cut into blocks, and each
    pair of blocks is a tile.  A tile of whole components labels its classes
    itself; the links of blocks are joined up over all tiles.
    """
    # One document stands for each class that may have links.
    reps = materialise(members.join(bound.withColumnRenamed("node", "sig"), "sig").groupBy("sig", "label").agg(
        F.min("h").alias("h"), F.first("n").alias("n")), "jaccard-reps")
    large = _large(reps)
    if not large.isEmpty():
        reps = materialise(_finer(rows, reps, large), "jaccard-reps")
        release(rows.sparkSession)
        large = _large(reps)
    total = reps.agg(F.sum("n")).first()[0] or 0
    shared = max(1, -(-total // TILE_SHINGLES))
    blocks = F.greatest(F.ceil(F.col("w") * 2 / F.lit(TILE_SHINGLES)), F.lit(1)).cast("int")
    placed = join_groups(reps, large.select("label", blocks.alias("blocks")), ["label"], F.col("sig")).select(
        "h", "sig", "label", "blocks", F.pmod("sig", F.col("blocks")).cast("int").alias("block"))
    tiles = F.when(F.col("blocks").isNull(), F.array(F.struct(
        F.pmod(F.xxhash64("label"), F.lit(shared)).alias("tile"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
            F.col("label").alias("tile"), F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))))
    placed = materialise(placed.select("h", "sig", F.coalesce("block", F.lit(-1)).alias("block"), tiles.alias("tiles")), "jaccard-placed")
    chosen = _texts(rows, placed)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t) for t in group.pop("text")]
        # A row whose hash collides does not stand for the class; of repeated rows one does.
        group["set"] = sets
        group = group[[signature(s) == sig for s, sig in zip(sets, group["sig"])]].drop_duplicates("sig")
        if not len(group):
            return _frame([], ["a", "b", "whole"])
        cross = group["i"].iloc[0] != group["j"].iloc[0]
        sets, sig = group["set"].tolist(), group["sig"].tolist()
        found = t_occurrence(sets, group["block"].tolist() if cross else None)
        whole = bool(group["i"].iloc[0] < 0)
        if whole:
            order = sorted(range(len(sig)), key=sig.__getitem__)  # a forest's root is its first, so its smallest class
            place = {k: p for p, k in enumerate(order)}
            forest = Forest(len(sig))
            for a, b in found:
                forest.add(place[a], place[b])
            found = [(k, order[forest.find(p)]) for p, k in enumerate(order) if forest.find(p) != p]
        return _frame([(sig[a], sig[b], whole) for a, b in found], ["a", "b", "whole"])
    dealt = chosen.select("sig", "block", "text", F.inline("tiles"))  # texts are smaller than their sets
    links = materialise(dealt.groupBy("tile", "i", "j").applyInPandas(search, "a long, b long, whole boolean"), "jaccard-links")
    release(rows.sparkSession)
    labels = links.filter("whole").select(F.col("a").alias("node"), F.col("b").alias("label"))
    between = links.filter("NOT whole").select("a", "b")
    return labels if between.isEmpty() else labels.unionAll(min_labels(between, "jaccard-label"))


def _large(reps: DataFrame) -> DataFrame:
    """Components ``(label, w)`` of more than a tile's shingles."""
    return materialise(reps.groupBy("label").agg(F.sum("n").alias("w")).filter(F.col("w") > TILE_SHINGLES), "jaccard-large")


def _texts(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """``text`` and the other columns of ``placed(h, sig, ...)``: the rows that have its hashes, repeated ones once a task."""
    # The filter keeps texts of other documents out of the join, which is of one kind at every size.
    texts = rows.select("h", "text").filter(may_hold(placed.select("h"))("h"))
    joined = texts.join(placed.hint("merge"), "h").drop("h")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column("sig").to_pylist(), map(hash, map(bytes, _raw(batch.column("text"))))))
            keep = [k not in seen and not seen.add(k) for k in keys]
            yield batch if all(keep) else batch.filter(pa.array(keep, pa.bool_()))
    return joined.mapInArrow(once, joined.schema)


def _finer(rows: DataFrame, reps: DataFrame, large: DataFrame) -> DataFrame:
    """``reps(sig, label, h, n)`` with the ``large(label, w)`` components bounded again; classes without links may go.

    Linked sets are of like sizes: a class meets those of its level, sizes
    from 4 ** level, and if small enough also those of the level below.  The shingles of a level are cut into parts by hash.  A
    link of two sets is one in a part at least, since overlap and union are
    the sums of the parts'.  So the components of the parts' links hold those
    of all links, and every shingle is sent once (twice near a level's start),
    whatever the component's size.
    """
    found = join_groups(reps, large, ["label"], F.col("sig"))
    small, big = found.filter("w IS NULL").drop("w"), found.filter("w IS NOT NULL").drop("w")
    level = F.floor((F.length(F.bin("n")) - 1) / 2).cast("int")
    first = F.expr("shiftleft(1L, 2 * level)")
    levels = F.when(PERCENT * F.col("n") <= 100 * (first - 1), F.array(F.col("level") - 1, "level")).otherwise(F.array("level"))
    big = materialise(big.withColumn("level", level).withColumn("level", F.explode(levels)), "jaccard-levels")
    # Parts hold eight shingles of a set at least, on average.
    parts = F.greatest(F.least(F.ceil(F.col("w") / F.lit(TILE_SHINGLES)), F.floor(first / 8)), F.lit(1)).cast("int")
    cuts = big.groupBy("label", "level").agg(F.sum("n").alias("w")).select("label", "level", parts.alias("parts"))
    placed = materialise(join_groups(big, cuts, ["label", "level"], F.col("sig")).groupBy("h", "sig", "label").agg(
        F.collect_list("level").alias("levels"), F.collect_list("parts").alias("parts")), "jaccard-parts")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Halves of the shingles per label, level and part."""
        names = ["label", "level", "part", "sigs", "sizes", "codes"]
        for batch in batches:
            held: dict[tuple[int, int, int], tuple[list[int], list[int], list[bytes]]] = {}
            columns = (batch.column(c).to_pylist() for c in ("sig", "label", "levels", "parts"))
            for text, sig, label, at, cut in zip(_raw(batch.column("text")), *columns):
                s = shingles(text)
                if signature(s) != sig:
                    continue
                for lev, k in zip(at, cut):
                    part = (s >> np.uint64(32)) % np.uint64(k)
                    order = np.argsort(part, kind="stable")
                    code, part = s[order].astype(np.uint32), part[order]
                    for lo, hi in _runs(part):
                        sigs, sizes, codes = held.setdefault((label, lev, int(part[lo])), ([], [], []))
                        sigs.append(sig)
                        sizes.append(hi - lo)
                        codes.append(code[lo:hi].tobytes())
            if held:
                out = [(*key, np.array(sigs, np.int64).tobytes(), np.array(sizes, np.uint32).tobytes(), b"".join(codes))
                       for key, (sigs, sizes, codes) in held.items()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (
                    pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(group["sigs"]), dtype=np.int64)
        size = np.frombuffer(b"".join(group["sizes"]), dtype=np.uint32)
        codes = np.split(np.frombuffer(b"".join(group["codes"]), dtype=np.uint32), np.cumsum(size)[:-1])
        at = np.unique(sig, return_index=True)[1].tolist()
        sets = [_told_apart(codes[k]) for k in at]
        sig = sig[at].tolist()
        return _frame([(sig[a], sig[b]) for a, b in t_occurrence(sets)], ["a", "b"])
    dealt = _texts(rows, placed).mapInArrow(deal, "label long, level int, part int, sigs binary, sizes binary, codes binary")
    edges = materialise(dealt.groupBy("label", "level", "part").applyInPandas(search, "a long, b long").distinct(), "jaccard-finer")
    if edges.isEmpty():
        return small
    again = big.select("sig", "h", "n").distinct().join(min_labels(edges, "jaccard-finer").withColumnRenamed("node", "sig"), "sig")
    return small.unionByName(again)


def _told_apart(codes: np.ndarray) -> np.ndarray:
    """32-bit halves of distinct shingles as distinct integers: equal halves are numbered, so that no overlap gets less."""
    codes = np.sort(codes).astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    number = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
    return codes + (number.astype(np.uint64) << np.uint64(32))


def _classed(members: DataFrame, labels: DataFrame | None, spread: Column) -> DataFrame:
    """``members`` with the ``class`` of each: its set's label, or the set where it has none."""
    return members.withColumn("class", F.col("sig")) if labels is None else join_groups(
        members, labels.withColumnRenamed("node", "sig"), ["sig"], spread).withColumn("class", F.coalesce("label", "sig"))


def _classes(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Class of every member, then the smallest id per class."""
    named = _classed(members, labels, F.col("doc_id")).select("doc_id", "n", "class")
    groups = named.filter(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return join_groups(named, groups, ["class"], F.col("doc_id")).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row per group of linked documents: the one with the smallest id; all columns as they are.

    Rows are told apart by id and text, so an id's other texts have their own
    fate.  Rows without id come last in their group, the smallest set and
    text hash first.  Texts without words link with nothing: of repeated rows
    (same id and text) one stays, those without id all stay.  Columns of any
    name are passed on.
    """
    rows = _keyed(docs)
    members, labels = _linked(rows)
    spread = F.struct("doc_id", "h")
    told = materialise(_classed(members.groupBy("doc_id", "h", "sig").agg(F.count(F.lit(1)).alias("k")), labels, spread)
                       .select("doc_id", "h", "sig", "class", "k"), "jaccard-rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig", "h")
    firsts = told.filter(F.col("class").isNotNull()).groupBy("class").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("texts")).filter("texts > 1").drop("texts")
    gone = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place)
    free = F.col("class").isNull() & F.col("doc_id").isNull()
    touched = materialise(join_groups(told, firsts, ["class"], spread).select(
        F.col("doc_id").alias("other"), "h", gone.alias("gone"), ((F.col("k") > 1) & ~gone & ~free).alias("several"))
        .filter("gone OR several"), "jaccard-touched")
    release(docs.sparkSession)  # before texts are shuffled
    # Rows that no verdict can touch pass by; only the others meet the verdicts, in one join of one kind at every size.
    met = may_hold(touched.select("h"))
    marked = nested(docs, doc_id=F.col("doc_id").cast("long"), h=F.xxhash64(F.col("doc_id").cast("long"), "text"))
    hit = marked.filter(met("h")).join(touched.hint("merge").withColumnRenamed("h", "key"), (F.col("h") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("other")), "left")
    out = marked.filter(~met("h")).select("row").unionAll(hit.filter("key IS NULL").select("row"))
    if not touched.filter("several").isEmpty():
        out = out.unionAll(hit.filter("several").dropDuplicates(["doc_id", "h"]).select("row"))
    return unnested(out)
