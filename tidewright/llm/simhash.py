"""SimHash near-dedup with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last is
padded with zeros). The binary Golay code [23, 12, 7] is perfect: each 23-bit
word decodes to one codeword within three bits. The near codewords of a segment
are those that it or a word one bit away decodes to, six at most; segments one
bit apart decode into each other's near codewords.

Pigeonhole over the segments of two fingerprints with three differing bits or
fewer: either a segment is equal and another differs in one bit at most, or each
differs in exactly one. So these keys meet: (equal segment, near codeword of
another) for the six choices, and (near, near, own) with (own, own, near)
codewords for the last case. Fingerprints that share a key are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import gives_back, materialize, text_bytes
from tidewright.llm.components import components

#: Generator of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (a fixed value).
GENERATOR = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Shingles whose bits are counted at a time.
_CHUNK = 1 << 15


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 11-bit remainder, the error pattern of three bits or fewer; each bit's remainder."""
    errors = np.zeros(1 << 11, np.uint32)
    single = [_remainder(1 << i) for i in range(23)]
    for n in (1, 2, 3):
        for bits in combinations(range(23), n):
            s = 0
            for i in bits:
                s ^= single[i]
            errors[s] = sum(1 << i for i in bits)
    return errors, np.array(single, np.uint32)


def decode(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword nearest to each 23-bit word."""
    errors, single = golay_tables()
    rest = np.zeros(words.shape, np.uint32)
    for i in range(23):
        rest ^= np.where(words >> np.uint32(i) & np.uint32(1), single[i], np.uint32(0))
    return (words ^ errors[rest]) >> np.uint32(11)


def near_codewords(words: np.ndarray, bits: int = 23) -> np.ndarray:
    """Six columns: the indices that a word and its one-bit neighbours decode to.

    The word's own index comes first; spare places repeat it.
    """
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    found = decode(words[:, None] ^ flips[None, :])
    own = found[:, 0].copy()
    found.sort(axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    new &= found != own[:, None]
    out = np.repeat(own[:, None], 6, axis=1)
    at = np.cumsum(new, axis=1)
    row, col = np.nonzero(new)
    out[row, at[row, col]] = found[row, col]
    return out


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of all keys of the 64-bit fingerprints, without repeats in a row."""
    n = len(prints)
    parts = [(prints >> np.uint64(at)).astype(np.uint64) & np.uint64((1 << bits) - 1) for at, bits in SEGMENTS]
    near = [near_codewords(p.astype(np.uint32), bits).astype(np.uint64) for p, (_, bits) in zip(parts, SEGMENTS, strict=True)]
    keys = []
    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                keys.append((parts[i][:, None] << np.uint64(12) | near[j]) << np.uint64(4) | np.uint64(kind))
                kind += 1
    own = [x[:, :1] for x in near]
    pairs = (near[0][:, :, None] << np.uint64(12) | near[1][:, None, :]).reshape(n, 36)
    keys.append((pairs << np.uint64(12) | own[2]) << np.uint64(4) | np.uint64(kind))
    keys.append(((own[0] << np.uint64(12) | own[1]) << np.uint64(12) | near[2]) << np.uint64(4) | np.uint64(kind))
    table = np.concatenate(keys, axis=1)
    table.sort(axis=1)
    new = np.ones(table.shape, bool)
    new[:, 1:] = table[:, 1:] != table[:, :-1]
    return np.nonzero(new)[0], table[new]


def fine_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)``: every choice of five of the eight bytes, as one key each.

    Three differing bits touch three bytes at most, so such fingerprints share a
    key; those that share one differ in 24 known places at most.
    """
    octets = [(prints >> np.uint64(8 * i)) & np.uint64(255) for i in range(8)]
    keys = []
    for kind, kept in enumerate(combinations(range(8), 5)):
        key = np.full(len(prints), kind, np.uint64)
        for i in kept:
            key = key << np.uint64(8) | octets[i]
        keys.append(key)
    return np.repeat(np.arange(len(prints)), len(keys)), np.stack(keys, axis=1).reshape(-1)


def forest(prints: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (``most`` differing bits) among distinct fingerprints."""
    left, a, b = prints, [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            p = front.pop()
            hit = np.bitwise_count(left ^ p) <= most
            if hit.any():
                found = left[hit]
                a.append(np.full(len(found), p, np.uint64))
                b.append(found)
                front.extend(found)
                left = left[~hit]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def fingerprint_of(text: bytes) -> int:
    """The SimHash of one whole text (bytes of UTF-8); see :func:`fingerprints`."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= 3:
        return digest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:-2].tolist()
    ends = ends[2:].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), _CHUNK):
        part = [digest(joined[s:e], 42) for s, e in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK], strict=True)]
        h = np.array(part, dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """Add the 64-bit SimHash of ``text`` as a long.

    A-Z are lower-cased; words are split at white space of one byte; every
    shingle of three words (all words, if fewer) counts as often as it occurs
    with its XXH64 (seed 42). A bit is set where over half the hashes have it.
    Null, empty and blank texts have fingerprint zero. One narrow pass.
    """

    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, offsets = text_bytes(column)
            raw = data.tobytes()
            found = [fingerprint_of(raw[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return docs.withColumn(out, simhash(F.col(text)))


def _keyed(make, batch_rows: int = 4096):
    @gives_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(prints), batch_rows):
                part = prints[i : i + batch_rows]
                row, key = make(part)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[row].view(np.int64))], names=["key", "fp"])

    return run


def _linked(limit: int):
    """Rows sorted by key in; links out, or the rows of keys with over ``limit`` rows.

    Holds one key's rows at a time, ``limit`` of them at most.
    """

    def batch(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(a), kind, np.int8)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b"])

    @gives_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, over = None, [], False

        def close() -> Iterator[pa.RecordBatch]:
            if held and not over:
                prints = np.unique(np.concatenate(held))
                if len(prints) > 1:
                    yield batch(0, *forest(prints))

        for rows in batches:
            key = rows.column(0).to_numpy(zero_copy_only=False)
            fp = rows.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            sizes = np.diff(starts)
            inner = np.zeros(len(sizes), bool)
            inner[1:-1] = True  # the first and last run may go on in other batches
            two = starts[:-1][(sizes == 2) & inner]
            near = (fp[two] != fp[two + 1]) & (np.bitwise_count(fp[two] ^ fp[two + 1]) <= 3)
            if near.any():
                yield batch(0, fp[two][near], fp[two + 1][near])
            for r in np.flatnonzero((sizes > 2) | ~inner).tolist():
                part, k = fp[starts[r] : starts[r + 1]], key[starts[r]]
                if k != held_key:
                    yield from close()
                    held_key, held, over = k, [], False
                if over:
                    yield batch(1, part, np.full(len(part), k, np.int64).view(np.uint64))
                    continue
                held.append(part)
                if sum(map(len, held)) > limit:
                    whole = np.concatenate(held)
                    yield batch(1, whole, np.full(len(whole), k, np.int64).view(np.uint64))
                    held, over = [], True
        yield from close()

    return run


def _bucketed(prints: DataFrame, make, limit: int) -> DataFrame:
    """``kind, a, b`` of the fingerprints that share a key; see :func:`_linked`."""
    keyed = prints.mapInArrow(_keyed(make), "key long, fp long")
    dealt = keyed.repartition(F.col("key")).sortWithinPartitions("key")
    return materialize(dealt.mapInArrow(_linked(limit), "kind byte, a long, b long"))


def _starred(rows: DataFrame) -> DataFrame:
    """Links among fingerprints ``a`` that share the fine key ``b``, with no pairs made.

    The key leaves 24 bits open. For each choice of three of them, fingerprints
    that are equal but for those three are within three bits of each other: all
    are tied to the smallest. Every pair within three bits has such a choice.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(combinations(range(8), 5))
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for p, k in zip(prints, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), strict=True):
                open_bits = [8 * i + j for i in range(8) if i not in kept[int(k) >> 40] for j in range(8)]
                masks = np.array([sum(1 << x for x in c) for c in combinations(open_bits, 3)], np.uint64)
                key = (p & ~masks) ^ (masks * _MIX)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array((p & ~masks).view(np.int64)), pa.array(np.full(len(key), p, np.uint64).view(np.int64))],
                    names=["key", "rest", "fp"],
                )

    stars = rows.mapInArrow(run, "key long, rest long, fp long")
    least = stars.groupBy(F.col("key").alias("k"), F.col("rest").alias("r")).agg(F.min("fp").alias("m"))
    tied = stars.join(least, (F.col("key") == F.col("k")) & (F.col("rest") == F.col("r")))
    return tied.select(F.col("fp").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def link_fingerprints(prints: DataFrame, limit: int = 16384) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints within three bits.

    ``prints`` has one column of distinct longs. A key's fingerprints give a
    spanning forest, so links number fewer than keys and no group makes pairs.
    Keys shared by more than ``limit`` fingerprints are not compared at once:
    their fingerprints get finer keys (five of eight bytes), and those still
    shared by too many are tied by stars without any comparison. All three ways
    are exact; together no link between components is lost.
    """
    first = _bucketed(prints, fuzzy_keys, limit)
    links = first.where("kind = 0").select("a", "b")
    crowded = first.where("kind = 1").select("a").distinct()
    if crowded.isEmpty():
        return links
    second = _bucketed(crowded, fine_keys, limit)
    links = links.unionByName(second.where("kind = 0").select("a", "b"))
    dense = second.where("kind = 1").select("a", "b")
    if not dense.isEmpty():
        links = links.unionByName(_starred(dense))
    return links


def labelled(docs: DataFrame, key: str, fp: str, limit: int = 16384) -> DataFrame:
    """``docs`` without its text, with its fingerprint ``fp``, ``root`` and ``component_id``."""
    rows = materialize(fingerprints(docs, fp).drop("text"))
    classes = materialize(rows.groupBy(F.col(fp).alias("p")).agg(F.min(key).alias("least")))
    rooted = components(link_fingerprints(classes.select("p"), limit))
    named = classes.join(rooted, F.col("p") == F.col("node"), "left").withColumn("root", F.coalesce("root", "p"))
    smallest = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = named.join(smallest, F.col("root") == F.col("r")).select("p", "root", "component_id")
    return rows.join(named, F.col(fp) == F.col("p")).drop("p")


def near_duplicates(docs: DataFrame, limit: int = 16384) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    ``fingerprint`` has 16 hex digits. Fingerprints of three differing bits or
    fewer are linked; ``component_id`` is the smallest ``doc_id`` reachable over
    links, a row's own included. Equal fingerprints (exact copies, and all texts
    without words) are one class from the start: only distinct fingerprints are
    keyed and compared, so a class of a third of all rows is one of them. Null
    ids are left out of the smallest (null if a component has no other).
    Repeated rows stay. An empty table stays empty. Other columns are not used.
    """
    found = labelled(docs.select("doc_id", "text"), "doc_id", "_fp", limit)
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")

