"""Language ID: string kernels, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import crc_mod, fresh, gives_back
from tidewright.llm.ngrams import class_sample, has_letter, presence_blocks

SIZES, BITS = (1, 2, 3), 15


@dataclass
class KernelRidge:
    """One-versus-rest ridge regression on the kernel with some landmarks.

    The kernel of two texts is the number of n-grams (1 to 3 bytes) that both
    have, over the root of the product of how many each has: a normalised
    blended-spectrum presence kernel.
    """

    classes: list[str]
    landmarks: np.ndarray  # packed presence rows
    weights: np.ndarray  # landmark by class

    def prepare(self) -> None:
        marks = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        self.columns = np.ascontiguousarray((marks / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))).T)

    def decide(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest class's number and its share of the clipped scores."""
        best, score = [], []
        for block in presence_blocks(column, SIZES, BITS, lower=True):
            grams = block.astype(np.float32)
            kernel = grams @ self.columns / np.sqrt(np.maximum(grams.sum(1, keepdims=True), 1))
            out = np.clip(kernel @ self.weights, 1e-6, 1)
            top = out.argmax(1)
            best.append(top)
            score.append(out[np.arange(len(top)), top] / out.sum(1))
        if not best:
            return np.zeros(0, int), np.zeros(0)
        return np.concatenate(best), np.concatenate(score).astype(float)


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norm = lambda x: np.sqrt(np.maximum(x.sum(1), 1))
    return (a @ b.T) / norm(a)[:, None] / norm(b)[None, :]


def fit(packed: np.ndarray, labels: list[str], per_class_landmarks: int = 16, most_landmarks: int = 3200, ridge: float = 1e-3) -> KernelRidge | None:
    """Fit on a bounded sample of packed presence rows; None without any text.

    A language has ``per_class_landmarks`` of its texts as landmarks, fewer (one at
    least) if there were over ``most_landmarks`` in all.
    """
    classes = sorted(set(labels))
    if not classes:
        return None
    grams = np.unpackbits(packed, axis=1).astype(np.float32)
    number = {c: i for i, c in enumerate(classes)}
    which = np.array([number[x] for x in labels])
    each = max(1, min(per_class_landmarks, most_landmarks // len(classes)))
    marks = np.concatenate([np.flatnonzero(which == k)[:each] for k in range(len(classes))])
    inner, cross = _kernel(grams[marks], grams[marks]).astype(float), _kernel(grams, grams[marks]).astype(float)
    # Each class counts alike, however many of its texts there are.
    share = 1.0 / np.bincount(which)[which]
    target = (which[:, None] == np.arange(len(classes))[None, :]).astype(float)
    left = (cross * share[:, None]).T @ cross + ridge * len(classes) * (inner + 1e-6 * np.eye(len(marks)))
    weights = np.linalg.solve(left, (cross * share[:, None]).T @ target)
    return KernelRidge(classes, packed[marks], weights.astype(np.float32))


def train(docs: DataFrame, learn: Column, per_class: int = 250, most: int = 20_000) -> KernelRidge | None:
    """Fit on at most ``per_class`` whole texts of each language in ``docs``, ``most`` in all; every language has some."""
    known = docs.where(learn & F.col("lang").isNotNull() & has_letter(F.col("text")))  # also of repeated ids only such rows
    return fit(*class_sample(known, known.select("doc_id", "lang"), "lang", per_class, most, seed=4, sizes=SIZES, bits=BITS, lower=True))


def predict(docs: DataFrame, model: KernelRidge | None) -> DataFrame:
    """Add ``lang_pred`` and ``lang_score`` (columns of that name, in any case, are replaced; all others stay).

    Whole texts are read, of any length. Null texts and texts without a letter
    are ``und`` with score 0, as are all texts without a model (no labelled
    text to learn from). Ties go to the language that sorts first. One narrow
    pass; rows and their order stay as they are.
    """

    @F.arrow_udf("lang string, score double")
    @gives_back
    def decide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model.prepare()
        names = np.array(model.classes, dtype=object)
        for column in batches:
            best, score = model.decide(column)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], names=["lang", "score"])

    und = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        found: Column = und
    else:
        found = F.when(has_letter(F.col("text")), decide("text")).otherwise(und)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "lang_score")])
    got = fresh(docs, "_found")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn(got, found).select(*kept, F.col(f"{got}.lang").alias("lang_pred"), F.col(f"{got}.score").alias("lang_score"))


def language_id(docs: DataFrame, per_class: int = 250) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document.

    Learns from documents with a language whose crc32 of the id's text is not a
    multiple of 5 (a bounded sample of ``per_class`` a language, 20,000 in all, each
    language in it); predicts from the text alone. Null ids are not learned from. Of
    an id that repeats, the smallest language and one text are. Repeated rows are
    judged alike; an empty table gives an empty one; other columns are not used.
    """
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = train(docs, ~held, per_class)
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
