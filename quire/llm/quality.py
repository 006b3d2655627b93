"""Ordinal quality classifier: cumulative-link regression on graded ratings.

One score per text, the sum of hashed-text weights, is held against ordered thresholds:
P(grade <= k) = sigmoid(threshold[k] - score). Grades here: 0 toxic, 1 poor, 2 good.
The fit uses a bounded sample of labelled rows (SAMPLE, taken by hash of doc_id); scoring
covers every row in its own partition, without a shuffle.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow, ship, table, worker_cache

BITS = 18
SAMPLE = 20_000
GRADES = 3
EPOCHS = 12
#: A row is kept if its probability of the top grade reaches this.
TAIL = 0.5
_SYMBOL = re.compile(rb"[^0-9A-Za-z\x80-\xff]+$")
#: Rows whose features are made at a time for the fit, so that a batch's features never lie in a worker together.
ROWS = 512


def _slot(name: bytes) -> int:
    return zlib.crc32(name) & (1 << BITS) - 1


def _traits(word: bytes) -> tuple[int, ...]:
    """Slots of a word: itself in lower case, its start, its tail of symbols, and whether it is all capitals."""
    low = word.lower()
    slots = [_slot(b"w:" + low)]
    if len(low) > 5:
        slots.append(_slot(b"p:" + low[:5]))
    if tail := _SYMBOL.search(low):
        slots.append(_slot(b"t:" + tail[0][:3]))
    if len(word) > 1 and word.isupper():
        slots.append(_slot(b"capitals"))
    return tuple(slots)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text: counts by the root of its number of words; both empty without words."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    found: dict[int, int] = {}
    known = worker_cache("quality")
    for word, n in Counter(words).items():
        slots = known.get(word)
        if slots is None:
            slots = _traits(word)
            if len(word) < 64:
                if len(known) >= 300_000:
                    known.clear()
                known[word] = slots
        for s in slots:
            found[s] = found.get(s, 0) + n
    again = sum(map(operator.eq, words, words[1:]))
    if again:
        found[_slot(b"again")] = again
    slots = np.fromiter(found.keys(), np.int32, len(found))
    counts = np.fromiter(found.values(), np.float32, len(found))
    return slots, counts / np.float32(np.sqrt(len(words)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class CumulativeLink:
    """weights by slot, and thresholds in rising order."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4, batch: int = 64) -> CumulativeLink:
    """Adagrad on the log likelihood, each grade weighing the same in all, in an order fixed by a seed."""
    weights = np.zeros(1 << BITS)
    squares = np.full(1 << BITS, 1e-3)
    at = np.linspace(-1, 1, GRADES - 1)
    at_squares = np.full(GRADES - 1, 1e-2)
    if not len(rows):
        return CumulativeLink(weights.astype(np.float32), np.full(GRADES - 1, -10.0))
    share = np.bincount(grades, minlength=GRADES).astype(float)
    weight = np.where(share > 0, len(rows) / (GRADES * np.maximum(share, 1)), 0) ** 0.5
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            sizes = np.array([len(rows[i][0]) for i in pick])
            slots = np.concatenate([rows[i][0] for i in pick])
            values = np.concatenate([rows[i][1] for i in pick])
            owner = np.repeat(np.arange(len(pick)), sizes)
            score = np.bincount(owner, weights[slots] * values, len(pick))
            y = grades[pick]
            below = np.concatenate([np.zeros((len(pick), 1)), _sigmoid(at[None, :] - score[:, None]), np.ones((len(pick), 1))], axis=1)
            upper, lower = below[np.arange(len(pick)), y + 1], below[np.arange(len(pick)), y]
            each = weight[y] * (1 - upper - lower)
            p = np.maximum(upper - lower, 1e-9)
            own, inverse = np.unique(slots, return_inverse=True)
            grad = np.bincount(inverse, each[owner] * values, len(own)) / len(pick) + decay * weights[own]
            squares[own] += grad**2
            weights[own] -= rate * grad / np.sqrt(squares[own])
            up, down = weight[y] * upper * (1 - upper) / p, weight[y] * lower * (1 - lower) / p
            g = np.array([down[y == j + 1].sum() - up[y == j].sum() for j in range(GRADES - 1)]) / len(pick)
            at_squares += g**2
            at = np.sort(at - rate * g / np.sqrt(at_squares))
    return CumulativeLink(weights.astype(np.float32), at)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 if any label of the document says toxic, else 2 if all say good, else 1; labels without a rating are left out."""
    rated = narrow(labels, "doc_id", "quality", "toxic").where("doc_id is not null and (quality is not null or toxic = 1)")
    each = rated.groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min(F.coalesce("quality", F.lit(0))).alias("quality"))
    return each.select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CumulativeLink:
    """Fits on at most `sample` labelled documents, the first by hash of doc_id; where rows repeat a doc_id, on at most
    2 * `sample` rows, the first by hash of their features.

    Features are made where the documents are; only the sample's features meet, in one task, and only
    weights and thresholds, of fixed size, reach the driver. Without labelled rows the model keeps every row.
    """
    ship(docs.sparkSession)
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    both = narrow(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                b = batch.iloc[at : at + ROWS]
                made = [features(t) for t in b["text"]]
                yield pd.DataFrame({"doc_id": b["doc_id"], "grade": b["grade"], "slots": [s.tobytes() for s, _ in made], "vals": [v.tobytes() for _, v in made]})

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "grade"])
        rows = [(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for s, v in zip(group["slots"], group["vals"], strict=True)]
        model = fit(rows, group["grade"].to_numpy(np.int64))
        return pd.DataFrame({"weights": [model.weights.tobytes()], "thresholds": [model.thresholds.astype(np.float64).tobytes()]})

    made = both.mapInPandas(make, "doc_id long, grade int, slots binary, vals binary").withColumn("all", F.lit(1))
    made = made.orderBy(F.xxhash64("doc_id", "slots", "vals"), "doc_id").limit(2 * sample)
    found = made.groupBy("all").applyInPandas(solve, "weights binary, thresholds binary").first()
    if found is None:
        return fit([], np.zeros(0, np.int64))
    return CumulativeLink(np.frombuffer(found["weights"], np.float32), np.frombuffer(found["thresholds"], np.float64))


def rate(docs: DataFrame, model: CumulativeLink, tail: float = TAIL) -> DataFrame:
    """docs and, last, expected_grade, p_not_toxic, p_good and kept.

    A null or empty text, or one without words, has score 0; equal texts rate alike; texts of any length are taken whole; an
    empty table gives no rows. Columns of docs that have one of these names give way to them; others stay as they are.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def score(text: pd.Series) -> pd.DataFrame:
        weights, thresholds = held.value
        scores = np.array([float(weights[s] @ v) for s, v in map(features, text)], np.float64)
        tails = CumulativeLink(weights, thresholds).tails(scores)
        return pd.DataFrame({"expected_grade": tails.sum(axis=1), "p_not_toxic": tails[:, 0], "p_good": tails[:, -1]})

    rated = docs.withColumn("_r", F.pandas_udf(score, "expected_grade double, p_not_toxic double, p_good double")("text"))
    names = ["expected_grade", "p_not_toxic", "p_good"]
    own = [F.col(f"`{c}`") for c in docs.columns if c not in {*names, "kept"}]
    return rated.select(*own, *[F.col(f"_r.{n}").alias(n) for n in names], (F.col("_r.p_good") >= tail).alias("kept"))


def select_good(docs: DataFrame, labels: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rows of docs that the classifier keeps, as they were."""
    marked = docs.withColumn("_given", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("_given", F.col("text"))
    kept = rate(marked, train(docs, labels), tail).where("kept")
    return kept.select(*[F.col("_given").getField(c).alias(c) for c in docs.columns])


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return rate(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "p_not_toxic", "p_good", "kept")
