"""Document fingerprints from Lempel-Ziv phrases.

A document is parsed into dictionary phrases: from each position the shortest
stretch of bytes that is not yet in the dictionary becomes a phrase. The phrase
set is hashed and the smallest hashes are kept, a minimum-hash signature. The
share of the smallest hashes of two documents' union that both have estimates
the overlap of their dictionaries, which is how well one compresses the other.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashes kept of each document.
KEEP = 128
_STEP, _MASK = 0x2545F491, (1 << 60) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def parse(data: bytes, phrases: set[int], state: int) -> int:
    """Extend the phrase set by ``data``; ``state`` is the open phrase's hash (0: none).

    A phrase is known by a polynomial hash of its bytes, built up byte by byte,
    so the dictionary holds integers. Returns the new state.
    """
    h, add = state, phrases.add
    for c in data:
        h = (h * _STEP + c + 1) & _MASK
        if h not in phrases:
            add(h)
            h = 0
    return h


def signature(phrases: set[int]) -> np.ndarray:
    """The ``KEEP`` smallest 32-bit hashes of a phrase set, sorted."""
    x = np.fromiter(phrases, np.uint64, len(phrases))
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    x *= _MIX
    h = (x >> np.uint64(32)).astype(np.uint32)
    if len(h) > 2 * KEEP:
        h = h[np.argpartition(h, 2 * KEEP - 1)[: 2 * KEEP]]  # spare ones for equal hashes
    return np.unique(h)[:KEEP]


def fingerprint_text(sig: np.ndarray) -> str:
    """A signature as text: eight hex digits for each hash; none for no phrases."""
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated overlap of two phrase sets, 0 to 1; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:KEEP]
    return float(len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / len(union))


def fingerprint(text: str) -> np.ndarray:
    """The signature of one whole text."""
    phrases: set[int] = set()
    parse(text.encode("utf-8", "replace"), phrases, 0)
    return signature(phrases)


def _pair(text: str, following: str) -> tuple[str, np.ndarray, np.ndarray]:
    """Edited text, signature, edited signature; the shared first part is parsed once."""
    half = len(text) // 2
    head, tail, put = text[: len(text) - half], text[len(text) - half :], following[:half]
    phrases: set[int] = set()
    state = parse(head.encode(), phrases, 0)
    other = set(phrases) if put != tail else phrases
    parse(tail.encode(), phrases, state)
    own = signature(phrases)
    if put == tail:
        return text, own, own
    parse(put.encode(), other, state)
    return head + put, own, signature(other)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``stretch, guest, doc_id, text`` sorted in; each row's next is the row after it in its stretch.

    Guests are the first rows of the stretch that follows: they come last and
    only serve the row before them. A row's likeness to its next is filled in
    once the next row's signature is known, so every text is parsed once.
    """
    out: list[list] = []
    held = None  # the row that waits for its next: stretch, doc_id, text
    waiting = None  # the signature of the last row of ``out``, which lacks its likeness to the next

    def fill(after: np.ndarray) -> None:
        nonlocal waiting
        if waiting is not None:
            out[-1].append(likeness(waiting, after))
            waiting = None

    def emit(row: tuple, following: str) -> None:
        nonlocal waiting
        _, doc_id, text = row
        edited, own, changed = _pair(text, following)
        fill(own)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append([doc_id, len(text), digest, fingerprint_text(own), fingerprint_text(changed), likeness(own, changed)])
        waiting = own

    def flush() -> pa.RecordBatch:
        done = out[: len(out) - (waiting is not None)]
        del out[: len(done)]
        columns = list(zip(*done, strict=True)) or [[] for _ in _NAMES]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)

    for batch in batches:
        columns = [batch.column(i) for i in range(4)]
        for i in range(batch.num_rows):
            stretch, guest, doc_id, text = (c[i].as_py() for c in columns)
            text = text or ""
            if held is not None and held[0] != stretch:  # no guest: nothing follows
                emit(held, held[2])
                fill(waiting)
                held = None
            if held is not None:
                emit(held, text)
            held = None if guest else (stretch, doc_id, text)
            if guest:
                fill(fingerprint(text) if waiting is not None else None)
            if len(out) > 500:
                yield flush()
    if held is not None:
        emit(held, held[2])
        fill(waiting)
    yield flush()


def _stretch(cuts: list[int], heavy: list[int], nulls: int):
    """The number of a row's stretch, along falling ids, and its rows' hashes where an id is heavy.

    ``cuts`` are falling ids that end a stretch; the rows of the ``i``-th have
    ``heavy[i]`` stretches of their own, by ranges of hashes, if that is not 0. Null ids
    have the last ``nulls`` stretches.
    """
    base = np.cumsum([0, *[1 + h for h in heavy]])

    def ranged(hashes: np.ndarray, n) -> np.ndarray:
        return np.minimum(np.floor((hashes / 2.0**64 + 0.5) * n).astype(np.int64), np.maximum(n, 1) - 1)

    @F.arrow_udf("int")
    def find(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        h = hashes.to_numpy(zero_copy_only=False)
        rising = np.array(cuts[::-1], np.int64)
        at = len(cuts) - np.searchsorted(rising, values, side="right")
        own = np.append(np.array(heavy, np.int64), 0)[at] if len(cuts) else np.zeros(len(values), np.int64)
        on_cut = (own > 0) & (np.append(np.array(cuts, np.int64), 0)[at] == values)
        out = base[at] + np.where(on_cut, 1 + ranged(h, np.maximum(own, 1)), 0)
        return pa.array(np.where(known, out, base[-1] + 1 + ranged(h, nulls)).astype(np.int32))

    return find, int(base[-1]) + 1 + nulls


def lz_fingerprints(docs: DataFrame, stretches: int | None = None, stretch_bytes: int = 128 << 20) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The edited text has the last half of the code
    points (rounded down) replaced by as many first ones of the next document in
    falling ``doc_id``, or all it has; after the last comes the first. Null texts
    are empty; null ids come last; rows of one id follow each other by their
    text's hash. A single row is its own next. Equal texts have equal
    fingerprints; texts without phrases have empty ones and are alike. An empty
    table gives an empty one; other columns are not used.

    Ids are cut into stretches of about ``stretch_bytes`` at quantiles (a bounded list
    of bounds); an id that is many quantiles, and null ids, are cut by their rows'
    hashes. Texts move once, to their stretch, where rows are taken one after
    another; each stretch also gets one guest, the first row of the next one, so no
    other order over all rows is needed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = stretches or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sizes.bytes or 0) // stretch_bytes))
    parts = [i / n for i in range(1, n)]
    bounds = rows.agg(F.percentile_approx("doc_id", parts, 10_000)).first()[0] if parts else []
    times = Counter(bounds or [])
    cuts = sorted(times, reverse=True)
    find, count = _stretch(cuts, [times[c] if times[c] > 1 else 0 for c in cuts], max(1, round(n * sizes.nulls / max(1, sizes.n))))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.bitwise_not("doc_id").alias("falling"), "h")
    tops = rows.groupBy(find("doc_id", "h").alias("s")).agg(F.min(F.struct(order.alias("order"), "doc_id", "h")).alias("top")).select("s", "top.doc_id", "top.h").collect()
    tops.sort(key=lambda r: r.s)
    dealt = rows.select(find("doc_id", "h").alias("stretch"), F.lit(False).alias("guest"), "doc_id", "text", "h")
    if tops:
        after = [(a.s, b.doc_id, b.h) for a, b in zip(tops, tops[1:] + tops[:1], strict=True)]
        wanted = F.broadcast(spark.createDataFrame(after, "stretch int, top long, top_h long"))
        guests = (
            rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("h") == F.col("top_h")))
            .groupBy("stretch")
            .agg(F.first(F.struct("doc_id", "text", "h")).alias("g"))
            .select("stretch", F.lit(True).alias("guest"), "g.doc_id", "g.text", "g.h")
        )
        dealt = dealt.unionByName(guests)
    sorted_rows = dealt.repartitionById(count, F.col("stretch")).sortWithinPartitions("stretch", "guest", F.col("doc_id").desc_nulls_last(), "h")
    return sorted_rows.select("stretch", "guest", "doc_id", "text").mapInArrow(_rows, SCHEMA)
