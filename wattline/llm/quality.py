"""Quality classifier from weak labels (operator 7).

Overlapping heuristic labellers vote good, bad or abstain on a text.
Expectation-maximisation over the table of vote patterns estimates each
labeller's accuracy and the share of good texts, without labelled rows.  The
posterior of each pattern is a probabilistic label; a linear scorer over
hashed features is trained on these labels and scores every text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import materialise

GOOD, BAD, ABSTAIN = 1, 0, -1
LABELLERS = ("marks", "capitals", "digits", "distinct words", "word length", "shouting", "short words",
             "repeated lines", "bare tokens", "stutter",
             "sentences")
#: Training uses at most about this many documents, drawn by the hash of the id, in this many shards.
TRAIN_DOCS = 16_000
TRAIN_SHARDS = 8
DIMENSIONS = 1 << 14
EPOCHS = 5
EM_STEPS = 200
#: Documents with at least this score are kept.
KEEP = 0.5


def _class(c: str) -> int:
    """1 upper case, 2 other letter, 3 digit, 4 white space, 5 sentence mark, 0 other."""
    return (1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace()
            else 5 if c in ".,;:?'\"()-" else 0)


CLASSES = np.array([_class(chr(c)) for c in range(0x3000)] + [2], dtype=np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def repeats(words: list[str]) -> float:
    """Share of words that repeat one of the two words before them."""
    if len(words) < 3:
        return 0.0
    return sum(a in (b, c) for a, b, c in zip(words[2:], words[1:], words)) / len(words)


def votes(text: str | None) -> list[int]:
    """One vote per labeller, in the order of ``LABELLERS``; an empty text gets a bad vote from each."""
    tokens = (text or "").split()
    words = [w for w in tokens if any(map(str.isalnum, w))]
    if not text or not words:
        return [BAD] * len(LABELLERS)
    n = len(words)
    kinds = np.bincount(CLASSES[np.minimum(_points(text), len(CLASSES) - 1)], minlength=6) / len(text)
    letters = kinds[1] + kinds[2]
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)

    def vote(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good else ABSTAIN
    capitals = kinds[1] / letters if letters else 1.0
    # Long texts repeat words anyway, so the share is of the first-seen words against a square-root law.
    distinct = len({w.lower() for w in words}) / min(n, 40 * math.sqrt(n))
    shouting = (text.count("!!") + text.count("??")) / n
    short = float((lengths <= 3).mean())
    again = 1 - len(set(lines)) / len(lines)
    stutter = repeats(words)
    # Symptoms vote bad or abstain; only signs of running prose vote good.
    return [vote(kinds[0] > 0.025, False), vote(capitals > 0.3, False), vote(kinds[3] > 0.1, False),
            vote(n >= 20 and distinct < 0.25, False), vote(not 2.5 <= lengths.mean() <= 15, False),
            vote(shouting > 0.1, False), vote(n >= 20 and short < 0.08, n >= 20 and short > 0.2),
            vote(again > 0.3, False), vote(len(tokens) > 1.1 * n, False), vote(stutter > 0.1, False),
            vote(False, kinds[0] < 0.01 and capitals < 0.15 and shouting < 0.02 and stutter < 0.05)]


def pattern(row: list[int]) -> int:
    """Votes as one number to base 3."""
    return sum((v + 1) * 3 ** k for k, v in enumerate(row))


def unpack(codes: np.ndarray) -> np.ndarray:
    """Patterns x labellers."""
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


@dataclass
class LabelModel:
    """Share of good texts, and each labeller's accuracy when it votes; an abstention says nothing."""

    good: float
    accuracy: np.ndarray

    def posterior(self, rows: np.ndarray) -> np.ndarray:
        """P(good) of each row of votes."""
        side = np.where(rows == ABSTAIN, 0, np.where(rows == GOOD, 1, -1))
        odds = math.log(self.good / (1 - self.good)) + side @ np.log(self.accuracy / (1 - self.accuracy))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_label_model(rows: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS) -> LabelModel:
    """EM over vote patterns and their counts; labellers are taken to be better than chance.

    Starts at accuracy 0.8 and an even share of good texts; one smoothing
    count per side.
    """
    model, p = LabelModel(0.5, np.full(rows.shape[1], 0.8)), None
    for _ in range(steps):
        new = model.posterior(rows)
        if p is not None and np.abs(new - p).max(initial=0.0) < 1e-9:
            break
        p = new
        right = np.where(rows == GOOD, p[:, None], 1 - p[:, None]) * (rows != ABSTAIN) * counts[:, None]
        voted = ((rows != ABSTAIN) * counts[:, None]).sum(axis=0)
        model = LabelModel(float(((counts * p).sum() + 1) / (counts.sum() + 2)),
                           np.clip((right.sum(axis=0) + 4) / (voted + 5), 0.55, 0.99))
    return model


def features(text: str | None, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text, as indices and values of unit length.

    A feature is a run of four symbols of the text's shape: letters, digits
    and white space fall in their classes and repeat once; marks stand for
    themselves.  One more feature stands for the share of words that repeat
    a word just before them, in tenths.
    """
    if not text:
        return np.zeros(0, np.int64), np.zeros(0)
    points = _points(text)
    kind = CLASSES[np.minimum(points, len(CLASSES) - 1)]
    shape = np.where((kind == 0) | (kind == 5), points + 8, kind)
    shape = np.concatenate((np.full(3, 7), shape[np.concatenate(([True], shape[1:] != shape[:-1]))]))
    codes = ((shape[:-3] * 1_000_003 + shape[1:-2]) * 1_000_003 + shape[2:-1]) * 1_000_003 + shape[3:]
    at, n = np.unique(((codes * 0x9E3779B97F4A7C1) >> 20) % (dimensions - 11), return_counts=True)
    again = dimensions - 1 - int(10 * repeats(text.split()))
    return np.append(at, again), np.append(np.sqrt(n / len(codes)), 1.0)


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], dimensions: int = DIMENSIONS,
                 epochs: int = EPOCHS) -> np.ndarray:
    """Logistic regression on probabilistic labels by stochastic steps; weights, then the bias."""
    w, b, step = np.zeros(dimensions), 0.0, 0
    for epoch in range(epochs):
        for k in np.random.Generator(np.random.PCG64(epoch)).permutation(len(rows)):
            at, value, label = rows[k]
            step += 1
            rate = 4.0 / math.sqrt(1 + step / 500)
            miss = label - 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[at] @ value) + b))))
            w[at] += rate * miss * value
            b += 0.05 * rate * miss
    return np.concatenate((w, [b]))


def classify(docs: DataFrame, keep: float = KEEP, train_docs: int = TRAIN_DOCS,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, weak_label, score, kept``.

    ``weak_label`` is the label model's P(good) from the votes, ``score`` the
    linear scorer's from the whole text; a row is kept if its score is at
    least ``keep``.  NULL and empty texts get bad votes and score 0.  The
    label model uses every document; the scorer is fitted on about
    ``train_docs`` of them, drawn by the hash of the id.  Repeated rows get
    equal results, other columns are ignored, an empty input gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    @F.pandas_udf("int")
    def voted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([pattern(votes(t)) for t in batch], dtype="int32")
    # At most 3 ** len(LABELLERS) rows.
    table = materialise(rows.select(voted("text").alias("votes")).groupBy("votes").count(), "quality-patterns").toPandas()
    codes = table["votes"].to_numpy(dtype=np.int64)
    model = fit_label_model(unpack(codes), table["count"].to_numpy(dtype=float))
    total = int(table["count"].sum())
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(1 << 40)).cast("double") / float(1 << 40)
    sample = rows.filter(draw < F.lit(train_docs / max(total, 1))) \
        .withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(TRAIN_SHARDS)))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(t or "" for t in group["text"])  # the same order on every retry
        label = model.posterior(np.array([votes(t) for t in texts]))
        w = train_scorer([(*features(t), float(p)) for t, p in zip(texts, label)])
        return pd.DataFrame({"w": [w.tobytes()]})
    # TRAIN_SHARDS vectors of DIMENSIONS + 1 numbers reach the driver.
    shards = [np.frombuffer(r["w"]) for r in sample.groupBy("shard").applyInPandas(fit, "w binary").collect()]
    shared = spark.sparkContext.broadcast(np.mean(shards, axis=0) if shards else np.zeros(DIMENSIONS + 1))

    @F.pandas_udf("weak_label double, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for batch in batches:
            label = model.posterior(np.array([votes(t) for t in batch]).reshape(-1, len(LABELLERS)))
            score = []
            for t in batch:
                at, value = features(t)
                score.append(1 / (1 + math.exp(-float(w[at] @ value) - w[-1])) if t and t.strip() else 0.0)
            yield pd.DataFrame({"weak_label": label, "score": score})
    out = rows.select("doc_id", scored("text").alias("s"))
    return out.select("doc_id", "s.weak_label", "s.score", (F.col("s.score") >= keep).alias("kept"))
