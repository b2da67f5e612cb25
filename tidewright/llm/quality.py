"""Quality classifier: naive Bayes support vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import crc_mod
from tidewright.llm.ngrams import class_sample, presence_blocks

SIZES, BITS = (1, 2, 3, 4), 16


@dataclass
class NbSvm:
    """A linear model on n-gram indicators of unit length, times log-count ratios."""

    weights: np.ndarray  # the ratios are multiplied in
    bias: float
    slope: float
    shift: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = [self.margin(block) for block in presence_blocks(column, SIZES, BITS, lower=False)]
        margin = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))

    def margin(self, block: np.ndarray) -> np.ndarray:
        grams = block.astype(np.float32)
        return (grams @ self.weights / np.sqrt(np.maximum(grams.sum(1), 1))).astype(float) + self.bias


def dual_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Hinge-loss support vectors by dual coordinate descent.

    Row ``i`` has the feature numbers ``rows[i]``; feature ``k`` has the value
    ``values[k]`` over the root of the row's length. The last weight is the bias.
    """
    rng = np.random.default_rng(9)
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(y))
    scale = np.array([1 / np.sqrt(max(1, len(r))) for r in rows])
    square = np.array([(values[r] ** 2).sum() for r in rows]) * scale**2 + 1
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            r = rows[i]
            v = values[r] * scale[i]
            slope = y[i] * (w[r] @ v + bias) - 1
            step = min(max(alpha[i] - slope / square[i], 0.0), cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[r] += step * y[i] * v
                bias += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return np.append(w, bias)


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities (Newton's method)."""
    theta = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - y) + 0.05 * (theta - np.array([1.0, 0.0]))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        theta = theta - np.linalg.solve(hess, grad)
    return (max(float(theta[0]), 1e-3), float(theta[1]))


def fit(packed: np.ndarray, labels: list[int], cost: float = 1.0) -> NbSvm | None:
    """Fit on a bounded sample of packed presence rows; None unless there are both classes."""
    y = np.array([1 if x == 1 else 0 for x in labels])
    if len(set(y.tolist())) < 2:
        return None
    rows = [np.flatnonzero(np.unpackbits(r)) for r in packed]
    size = 1 << BITS

    def model(use: np.ndarray) -> tuple[np.ndarray, float]:
        sums = [np.bincount(np.concatenate([rows[i] for i in use if y[i] == k] or [np.zeros(0, int)]), minlength=size) + 1.0 for k in (0, 1)]
        n = [max(1, int((y[use] == k).sum())) for k in (0, 1)]
        ratio = np.log(sums[1] / (n[1] + 2)) - np.log(sums[0] / (n[0] + 2))
        each = cost * np.where(y[use] == 1, len(use) / (2 * n[1]), len(use) / (2 * n[0]))
        w = dual_descent([rows[i] for i in use], ratio, np.where(y[use] == 1, 1.0, -1.0), each)
        return w[:-1] * ratio, w[-1]

    # Probabilities from rows that the weights did not see.
    folds = np.arange(len(y)) % 4
    w, b = model(np.flatnonzero(folds != 0)) if len(set(y[folds != 0].tolist())) == 2 else model(np.arange(len(y)))
    seen = np.array([w[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + b for i in np.flatnonzero(folds == 0)])
    slope, shift = _logistic(seen, y[folds == 0].astype(float))
    w, b = model(np.arange(len(y)))
    return NbSvm(w.astype(np.float32), float(b), slope, shift)


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", per_class: int = 1500) -> NbSvm | None:
    """Fit on at most ``per_class`` whole labelled texts of each class."""
    rows = labels.where(learn & F.col(label).isin(0, 1)).select("doc_id", label)
    return fit(*class_sample(docs, rows, label, per_class, 2 * per_class, seed=9, sizes=SIZES, bits=BITS, lower=False))


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    ``score`` is the likelihood of quality 1, from the whole text alone. Learns
    from labels whose crc32 of the id's text modulo 3 is not 1 (a bounded sample
    of ``per_class`` a class). A null text is the empty text and is scored as
    such. Labels other than 0 and 1, and labels without a document, are not
    used; of an id with several labels the smallest is. Without labels of both
    classes every score is 0.5. One narrow pass over the texts; rows stay as they
    are, repeated rows too; an empty table gives an empty one; other columns of
    either table are not used.
    """
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = train(docs, labels, ~held, per_class=per_class)
    score: Column = F.lit(0.5)
    if model is not None:

        @F.arrow_udf("double")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in batches:
                yield pa.array(model.score(column), pa.float64())

        score = scored("text")
    rows = docs.select("doc_id", "text").withColumn("score", score)
    return rows.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
