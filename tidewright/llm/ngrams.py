"""Presence of byte n-grams, for many texts at a time in numpy."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import by_bytes, materialize, text_bytes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def presence(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int, lower: bool) -> np.ndarray:
    """A row of ``2 ** bits`` zeros and ones for each text.

    A one marks that an n-gram of one of the ``sizes`` (1 to 4 bytes) occurs
    whose hash is that bin. No n-gram spans two texts.
    """
    rows = len(offsets) - 1
    out = np.zeros((rows, 1 << bits), np.uint8)
    if not len(data):
        return out
    flat = out.reshape(-1)
    if lower:
        data = LOWER[data]
    lengths = np.diff(offsets)
    base = np.repeat(np.arange(rows, dtype=np.int64) << bits, lengths)
    left = np.repeat(offsets[1:], lengths) - np.arange(len(data))  # bytes to the text's end
    wide = data.astype(np.uint32)
    code = np.zeros(len(data), np.uint32)
    for n in range(1, max(sizes) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint32(8)) | wide[n - 1 :]
        if n not in sizes:
            continue
        fits = left[:m] >= n
        h = ((code + np.uint32(0x9E3779B9 * n & 0xFFFFFFFF)) * np.uint32(2654435761)) >> np.uint32(32 - bits)
        flat[(base[:m] + h)[fits]] = 1
    return out


def presence_blocks(
    column: pa.Array, sizes: tuple[int, ...], bits: int, lower: bool, most_bytes: int = 1 << 20, most_rows: int = 128
) -> Iterator[np.ndarray]:
    """Presence matrices of the texts in order, some rows and bytes at a time."""
    data, offsets = text_bytes(column)
    for i, j in by_bytes(offsets, most_bytes):
        for a in range(i, j, most_rows):
            b = min(j, a + most_rows)
            yield presence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], sizes, bits, lower)


def sampled_texts(docs: DataFrame, rows: DataFrame, label: str, per_class: int, most: int, seed: int) -> tuple[DataFrame | None, int, dict]:
    """``_h, doc_id, _l, text`` of a little more than a bounded sample of labelled texts, how many to take of a label, and the labels' numbers of ids.

    ``rows`` has ``doc_id`` and ``label``; ``docs`` the texts. ``per_class`` ids of each
    label are wanted, fewer (but of every label) if that were over ``most`` in all: those
    with the smallest ``_h``, so the same ones however the tables are dealt. A
    bound on the hash, a little above what is needed, leaves the others out in one
    filter; nothing is ranked. An id that has several labels has its smallest,
    and one that has several texts that with the smallest hash. None without labels.
    """
    ids = rows.select("doc_id", F.col(label).alias("_l")).where("doc_id is not null and _l is not null").groupBy("doc_id").agg(F.min("_l").alias("_l"))
    ids = materialize(ids.withColumn("_h", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))))
    sizes_of = ids.groupBy("_l").agg(F.count(F.lit(1)).alias("n"))
    classes = sizes_of.count()
    if not classes:
        return None, 0, {}
    each = max(1, min(per_class, most // classes))
    some = float(each + 10 + 8 * math.isqrt(each))  # enough ids lie under the bound, but for a chance in billions
    wanted = sizes_of.select(F.col("_l").alias("_k"), "n")
    near = ids.join(F.broadcast(wanted), F.col("_l") == F.col("_k")).where(F.col("_h").cast("double") * F.col("n") < some * float(1 << 40))
    near = near.select(F.col("doc_id").alias("_d"), "_l", "_h")
    picked = docs.select("doc_id", "text").join(F.broadcast(near), F.col("doc_id") == F.col("_d"))
    picked = picked.groupBy("_h", "doc_id", "_l").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return picked, each, {r["_l"]: r["n"] for r in sizes_of.collect()} if classes <= 1000 else {}


def first_of_each(got: list, each: int) -> list:
    """The ``each`` rows of each label with the smallest hashes."""
    taken: Counter = Counter()
    kept = []
    for r in sorted(got, key=lambda r: (r["_h"], r["doc_id"])):
        taken[r["_l"]] += 1
        if taken[r["_l"]] <= each:
            kept.append(r)
    return kept


def class_sample(docs: DataFrame, rows: DataFrame, label: str, per_class: int, most: int, seed: int, sizes: tuple[int, ...], bits: int, lower: bool) -> tuple[np.ndarray, list]:
    """Packed presence rows and labels of a bounded sample of labelled texts, in a fixed order.

    The sample is that of :func:`sampled_texts`. Texts become presence bits inside Spark,
    so what the driver gets is bounded in bytes, however long the texts are.
    """
    picked, each, _ = sampled_texts(docs, rows, label, per_class, most, seed)
    if picked is None:
        return np.zeros((0, (1 << bits) // 8), np.uint8), []

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = [np.packbits(block, axis=1) for block in presence_blocks(column, sizes, bits, lower)]
            yield pa.array([row.tobytes() for block in found for row in block], pa.binary())

    kept = first_of_each(picked.select("_h", "doc_id", "_l", packed("text").alias("grams")).collect(), each)
    grams = np.frombuffer(b"".join(r["grams"] for r in kept), np.uint8).reshape(len(kept), (1 << bits) // 8)
    return grams, [r["_l"] for r in kept]


def has_letter(text: Column) -> Column:
    """Whether there is any letter; null has none."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
