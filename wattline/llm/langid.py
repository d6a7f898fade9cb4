"""Language identification by rank-order n-gram profiles (operator 4).

A profile is the list of a language's most frequent character n-grams (n = 1
to 3, padded words) in order of rank.  A document's own most frequent n-grams
are compared to each profile by the out-of-place distance: the sum of rank
differences, with a fixed penalty for an n-gram the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import nested, unnested

#: N-grams kept of a language and of a document.
PROFILE = 400
DOCUMENT = 300
#: Training uses at most about this many documents per language, drawn by the hash of the id.
TRAIN_DOCS = 20_000
UNDETERMINED = "und"
#: N-grams that a training task counts at once.
CHUNK = 1 << 21
#: A text under this score resembles no learned language; running text of one scores about 0.5 and more.
LEAST_SCORE = 0.2
GRAM_BITS = 21


def fold(of: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out.  A NULL id is in the fold of the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(of.cast("string"), F.lit("")), "UTF-8")), F.lit(4))


def _points(text: str) -> np.ndarray:
    """Lower-cased code points with every non-letter as 0 and one 0 on each side; empty if there is no letter."""
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = LETTERS[np.minimum(codes, len(LETTERS) - 1)]
    codes = np.where(kinds, codes, 0).astype(np.int64)
    if not codes.any():
        return codes[:0]
    # Runs of non-letters count once.
    keep = (codes != 0) | np.concatenate(([True], codes[:-1] != 0))
    return np.concatenate(([0], codes[keep], [0])) if codes[0] else np.concatenate((codes[keep], [0]))


#: Letters of all scripts, by code point.
LETTERS = np.array([chr(c).isalpha() for c in range(0x32000)] + [False])


def grams(text: str) -> np.ndarray:
    """All n-grams of ``text`` as integers: code points packed in 21 bits each.

    A word gap may stand at an n-gram's ends only.  Lengths do not mix: a
    gap code is 0, so a shorter n-gram is marked in the top bits.
    """
    p = _points(text)
    if not len(p):
        return p
    inner = p[1:-1] != 0
    three = ((p[:-2] << (2 * GRAM_BITS)) | (p[1:-1] << GRAM_BITS) | p[2:])[inner]
    two = ((p[:-1] << GRAM_BITS) | p[1:])[(p[:-1] | p[1:]) != 0]
    # Code points stay under 2**20 + 2**16, so three of them leave the sign bit free: shorter n-grams are negative.
    return np.concatenate((three, -1 - two, -1 - (1 << 61) - p[p != 0]))


def ranked(found: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` n-grams of highest count, ties by code, in order of rank."""
    if len(found) > most:
        # Everything above the cut, and of those at the cut the smallest codes (``found`` is sorted).
        cut = np.partition(counts, len(counts) - most)[len(counts) - most]
        above = np.flatnonzero(counts > cut)
        keep = np.sort(np.concatenate((above, np.flatnonzero(counts == cut)[:most - len(above)])))
        found, counts = found[keep], counts[keep]
    return found[np.argsort(-counts, kind="stable")]


def train(docs: DataFrame, profile: int = PROFILE, per_lang: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Profiles by language, from rows (doc_id, text, lang) with a language; at most ``profile`` codes each.

    N-gram counts are summed per task and then per (language, n-gram).  Only
    the profiles reach the driver: ``profile`` numbers per language.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # A draw by the hash of the id, so the sample is the same in every run.
    unit = F.pmod(F.xxhash64(F.lit("profile"), F.col("doc_id")), F.lit(1_000_000)) / 1_000_000.0
    chance = F.lit(0.0)
    for row in sizes.collect():  # one row per language
        chance = F.when(F.col("lang") == row["lang"], per_lang / row["n"]).otherwise(chance)
    drawn = labelled.filter(unit < chance).select("lang", "text")

    def tally(lang: str, held: list[np.ndarray]) -> pd.DataFrame:
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"lang": lang, "gram": codes.astype(np.int64), "n": n.astype(np.int64)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Partial counts; a task holds about CHUNK n-grams at a time."""
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                held, size = [], 0
                for text in part["text"]:
                    held.append(grams(text))
                    size += len(held[-1])
                    if size >= CHUNK:
                        yield tally(lang, held)
                        held, size = [], 0
                if held:
                    yield tally(lang, held)
    sums = drawn.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("r", place).filter(F.col("r") <= profile)
    out: dict[str, list[tuple[int, int]]] = {}
    for row in top.collect():
        out.setdefault(row["lang"], []).append((row["r"], row["gram"]))
    return {lang: np.array([g for _, g in sorted(found)], dtype=np.int64) for lang, found in sorted(out.items())}


class Scorer:
    """Distances of a document to every profile at once."""

    def __init__(self, profiles: dict[str, np.ndarray], document: int = DOCUMENT):
        self.langs, self.document = list(profiles), document
        self.codes = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.miss = max([len(p) for p in profiles.values()], default=0)
        # Rank of each known n-gram in each profile; -1 where the profile lacks it.
        self.rank = np.full((len(self.codes) + 1, len(profiles)), -1, dtype=np.int32)
        for k, p in enumerate(profiles.values()):
            self.rank[np.searchsorted(self.codes, p), k] = np.arange(len(p))

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = grams(text) if text else ()
        if not len(found) or not self.langs:
            return UNDETERMINED, 0.0
        own = ranked(*np.unique(found, return_counts=True), self.document)
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        rank = self.rank[at]
        apart = np.where(rank < 0, self.miss, np.minimum(np.abs(rank - np.arange(len(own))[:, None]), self.miss))
        total = apart.sum(axis=0)
        best = int(np.argmin(total))
        return self.langs[best], float(1.0 - total[best] / (self.miss * len(own)))


def scores(profiles: dict[str, np.ndarray], document: int = DOCUMENT):
    """A column function of a text: ``struct(lang_pred, score)``, from the whole text alone.

    ``lang_pred`` is a learned language, or ``und`` with score 0 if the text
    is NULL or has no letter (or nothing was learned).  ``score`` is 1 minus
    the smallest distance over the largest possible one; of languages at the
    same distance the first in alphabetical order wins.
    """
    @F.pandas_udf("lang_pred string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = Scorer(profiles, document)
        for batch in batches:
            yield pd.DataFrame([of(t) for t in batch], columns=["lang_pred", "score"])
    return score


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Profiles from the folds that are not held out."""
    return train(docs.filter(fold(F.col("doc_id")) != 2).select("doc_id", "text", "lang"))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the folds that are not held out; predict every row: ``doc_id, held_out, lang_pred, score``.

    Rows with a NULL language or text are not learned from; all rows are
    predicted, repeated rows alike.  Other columns are ignored.
    """
    score = scores(learn(docs))
    return docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), score(F.col("text")).alias("s")) \
        .select("doc_id", "held_out", "s.lang_pred", "s.score")


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is determined with at least ``least`` score; columns of any name as they are."""
    score = scores(learn(docs))
    return unnested(nested(docs, found=score(F.col("text"))).filter(
        (F.col("found.lang_pred") != UNDETERMINED) & (F.col("found.score") >= least)))
