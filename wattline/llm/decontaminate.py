r"""Benchmark decontamination by winnowing (operator 1).

Words of a text are hashed in k-grams; of each window of 10 words the smallest
k-gram hash is kept as a fingerprint.  A window that a document shares with an
item has the same smallest hash on both sides, so joining the documents' few
fingerprints with the items' finds every document that shares a window.  Only
those documents' windows are then compared word by word, around the
fingerprints that hit.  SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import let, lower_ascii, materialise, nested, unnested

WINDOW = 10
GRAM = 5
#: Everything that is not a word character once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column | str) -> Column:
    """Words of the lower-cased text, in order; none for NULL."""
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), BETWEEN), "")


def _grams(w: Column, k: int) -> Column:
    """Hash of each run of ``k`` words (none if there are fewer)."""
    zipped = F.arrays_zip(*[F.slice(w, j + 1, F.greatest(F.size(w) - k + 1, F.lit(0))) for j in range(k)])
    return F.transform(zipped, lambda x: F.xxhash64(x))


def fingerprints(w: Column, length: int) -> Column:
    """Fingerprint of each window of ``length`` words, in order: its smallest k-gram hash."""
    k = min(GRAM, length)
    n = length - k + 1
    if n == 1:
        return _grams(w, k)
    return let(_grams(w, k), lambda h: F.transform(
        F.arrays_zip(*[F.slice(h, j + 1, F.greatest(F.size(h) - n + 1, F.lit(0))) for j in range(n)]),
        lambda x: F.least(*[x[str(j)] for j in range(n)])))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, length, content, fp``: the distinct windows of each item; an item under ``window`` words is one."""
    split = items.select("item_id", words("text").alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    parts = split.select("item_id", length.alias("length"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice(F.col("w"), i, length))).alias("words"))
    fp = F.lit(None).cast("long")
    for m in range(1, window + 1):
        fp = F.when(F.col("length") == m, fingerprints(F.col("words"), m)[0]).otherwise(fp)
    return parts.select("item_id", "length", F.array_join("words", " ").alias("content"), fp.alias("fp")).distinct()


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])


def find_hits(rows: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, key, n_hit, ids`` of the rows (doc_id, key, text) with hits; ``key`` tells texts of one id apart.

    The planner broadcasts the items' side of a join only if it is under the
    session's threshold.
    """
    tests = materialise(item_windows(items, window), "decon-items")
    spans = materialise(tests.select("length", "content", "fp").distinct()
                        .withColumn("span", F.xxhash64("length", "content")), "decon-spans")
    lengths = sorted(r["length"] for r in tests.select("length").distinct().collect())  # at most `window` values
    hits = rows.sparkSession.createDataFrame(
        [], f"{rows.select('doc_id').schema[0].simpleString().replace(':', ' ')}, key long, start int, length int, span long")
    for m in lengths:
        own = spans.filter(F.col("length") == m)
        marks = rows.select("doc_id", "key", F.explode(let(
            words("text"), lambda w: F.array_distinct(fingerprints(w, m)))).alias("fp"))
        suspects = materialise(marks.join(own.select("fp").distinct(), "fp", "left_semi")
                               .select("doc_id", "key").distinct(), f"decon-suspects-{m}")
        near = rows.join(suspects, _same(rows, suspects), "left_semi")
        windows = near.select("doc_id", "key", F.inline(let(words("text"), lambda w: F.transform(
            fingerprints(w, m), lambda fp, i: F.struct(
                i.alias("start"), fp.alias("fp"), F.array_join(F.slice(w, i + 1, F.lit(m)), " ").alias("content"))))))
        hits = hits.unionByName(windows.join(own.select("fp", "content", "span"), ["fp", "content"]).select(
            "doc_id", "key", "start", F.lit(m).alias("length"), "span").distinct())
    hits = materialise(hits, "decon-hits")
    # Words covered: each window adds what lies beyond the furthest end so far.
    before = Window.partitionBy("doc_id", "key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = hits.select("doc_id", "key", "start", "length").distinct().withColumn(
        "n", F.greatest(end - F.greatest(F.coalesce(F.max(end).over(before), F.lit(0)), F.col("start")), F.lit(0)))
    covered = fresh.groupBy("doc_id", "key").agg(F.sum("n").alias("n_hit"))
    owners = tests.select(F.xxhash64("length", "content").alias("span"), "item_id").distinct()
    met = hits.select("doc_id", "key", "span").distinct().join(owners, "span") \
        .groupBy("doc_id", "key").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    return materialise(covered.join(met, _same(covered, met), "left").select(
        covered["doc_id"], covered["key"], "n_hit", "ids"), "decon-docs")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A document word is hit if it lies in an occurrence of a window of any
    item.  ``items_sha256`` digests the ids of items with occurring windows,
    sorted as strings, comma-joined (the empty string if none).  A NULL text
    has no words; items without words have no windows; repeated documents get
    equal rows and repeated items count once per id.  Other columns are ignored.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    found = find_hits(rows, items, window)
    counted = rows.select("doc_id", "key", F.size(words("text")).cast("long").alias("n_words"))
    ids = F.array_sort(F.coalesce("ids", F.array().cast("array<string>")))
    return counted.join(found, _same(counted, found), "left").select(
        counted["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that share no window with an item; columns of any name as they are."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    found = find_hits(rows, items, window).select(F.col("doc_id").alias("other"), F.col("key").alias("hit"))
    return unnested(nested(docs, doc_id=F.col("doc_id"), key=F.xxhash64("text")).join(
        found, F.col("doc_id").eqNullSafe(F.col("other")) & (F.col("key") == F.col("hit")), "left_anti"))
