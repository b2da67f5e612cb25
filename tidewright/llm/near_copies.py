"""One document of each group of near-copies: SimHash with Golay keys, then a prefix filter.

First the operator of :mod:`tidewright.llm.simhash`: whole texts get 64-bit fingerprints,
which meet under Golay codewords and link at three differing bits or fewer. These links
all hold. They tell close copies; texts that share four fifths of their shingles
differ in more bits, so a prefix filter follows for what they leave apart.

There texts are alike by their sets of five-word shingles. With all shingles in one
order, two sets of similarity ``REACH`` or more share one of the first
``n - ceil(REACH * n) + 1`` of each set of ``n``: the keys. So every such pair
meets, however its edits lie. Any order will do, so common shingles come last,
where they make no large groups. Candidates are then verified on a SimHash of
1024 bits over the set, whose distance tells the similarity.

Keys that lie within one component by the fingerprints' links are done with. Of the others
each member is held against the key's first one only, a star. Only keys whose members
are still in several components after that have all their members compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tidewright.llm.common import by_bytes, fresh, gives_back, materialize, read_order, text_bytes
from tidewright.llm.components import components
from tidewright.llm.simhash import fingerprint_of, link_fingerprints

#: Words of a shingle. All pairs from this similarity on are candidates: the sketch links some that
#: share less than four fifths, and whether those meet is not to hang on the order of the shingles.
SHINGLE, REACH = 5, 0.7
#: Bins, a power of two, in which the shingles of all texts are counted, and how many more than the
#: usual a bin with common shingles has. A bin's other shingles come late in the order with
#: them, which changes where rows meet, not whether a pair meets. Counts move in blocks.
BINS, COMMON, BLOCK = 1 << 20, 64, 1 << 12
#: Bytes of the sketch that verifies, and its bits that may differ. Shingle sets of
#: similarity 0.8 differ in 155 of the 1024 bits on average, give or take 12; 0.7 in 196.
SKETCH, MOST_BITS = 128, 172
#: The part of it that leaves out chance meetings first, with room: texts that the whole
#: sketch links differ in 43 of its 256 bits at most on average, give or take 6.
COARSE, COARSE_BITS = 32, 80
_LANES = np.arange(1, SKETCH // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 13


def _spread(hashes: np.ndarray, lanes: np.ndarray = _LANES) -> np.ndarray:
    """As many independent 64-bit hashes as there are lanes, from one each."""
    x = hashes[:, None] + lanes[None, :]
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _sketch(hashes: np.ndarray) -> bytes:
    """The SimHash of a set of hashes: a bit is set where over half of them have it."""
    ones = np.zeros(8 * SKETCH, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(_spread(hashes[i : i + _CHUNK]).view(np.uint8), axis=1)
        for j in range(0, len(bits), 255):  # sums of 255 rows fit a byte
            ones += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the set of five-word shingles, sorted; fewer than five words are one shingle."""
    words = text.lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 50)] if words else [], np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(w, 50) for w in words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    mixed = sum(_spread(each[i : i + n], _LANES[i : i + 1])[:, 0] for i in range(SHINGLE))
    return np.unique(_spread(mixed, _LANES[:1])[:, 0])


def prefix(hashes: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first of a sorted set: all but ``ceil(REACH * n)`` and one more.

    The order is by hash, then those in ``common`` (sorted) by their ``place``.
    """
    n = len(hashes)
    most = min(n, n - math.ceil(round(REACH * n, 6)) + 1)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        late = common[at] == hashes
        if late.any():
            last = hashes[late][np.argsort(place[at[late]], kind="stable")]
            hashes = np.concatenate([hashes[~late], last])
    return hashes[:most]


def _bin(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BINS - 1)).astype(np.int64)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Of each bin the place of its shingles in the order: 0, or from 1 on, by the bin's count, where common ones are.

    Every text counts, with all its shingles. A common shingle makes its bin stand
    out, so none is missed; the table has a size of its own, whatever the texts' number.
    """

    def blocks(at: Iterable[int], counts: Iterable[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], names=["block", "counts"])

    @gives_back
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in by_bytes(offsets, 1 << 22):
                at = offsets[i : j + 1].tolist()
                found = [shingles(data[k:m].tobytes()) for k, m in zip(at[:-1], at[1:], strict=True)]
                counts += np.bincount(_bin(np.concatenate(found)), minlength=BINS)
        yield blocks(range(BINS // BLOCK), counts.reshape(-1, BLOCK))

    @gives_back
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(counts, np.int64)
        yield blocks(sums.keys(), sums.values())

    kind = "block int, counts binary"
    summed = docs.select("text").mapInArrow(count, kind).repartition(F.col("block")).mapInArrow(add, kind).toArrow()
    counts = np.zeros((BINS // BLOCK, BLOCK), np.int64)
    for at, raw in zip(summed.column("block").to_pylist(), summed.column("counts").to_pylist(), strict=True):
        counts[at] = np.frombuffer(raw, np.int64)
    counts = counts.ravel()
    usual = np.median(counts)
    more = counts >= usual + max(COMMON, 4 * math.sqrt(usual))  # chance alone gives 4 deviations to few
    place = np.zeros(BINS, np.int32)
    place[more] = 1 + np.unique(counts[more], return_inverse=True)[1]
    return place


def signatures(docs: DataFrame) -> DataFrame:
    """``text`` (null: empty) replaced by ``sig``, its sketch, ``keys``, the first of its shingles, and ``fp``.

    ``fp`` is its 64-bit fingerprint (:mod:`tidewright.llm.simhash`). Texts without words
    have a sketch and a fingerprint of zeros and no keys.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    @F.arrow_udf("struct<sig:binary,keys:array<bigint>,fp:bigint>")
    @gives_back
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = sent.value
        for column in batches:
            data, offsets = text_bytes(column)
            raw, at = data.tobytes(), offsets.tolist()
            sketches, keys, ends, prints = [], [np.zeros(0, np.uint64)], [0], []
            for i, j in zip(at[:-1], at[1:], strict=True):
                hashes = shingles(raw[i:j])
                sketches.append(_sketch(hashes))
                place = places[_bin(hashes)]
                keys.append(prefix(hashes, hashes[place > 0], place[place > 0]))
                ends.append(ends[-1] + len(keys[-1]))
                prints.append(fingerprint_of(raw[i:j]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            fps = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.StructArray.from_arrays([pa.array(sketches, pa.binary()), lists, fps], names=["sig", "keys", "fp"])

    return docs.withColumn("s", run(F.col("text"))).drop("text").select("*", "s.*").drop("s")


def _shared(limit: int):
    """``key, cid, first`` of rows sorted by key whose key another row has too, once for each set of rows.

    Close copies meet under hundreds of keys. Keys of the same members are one
    candidate group, so rows get their group's members, hashed together, for a
    key. ``first`` is one member of the group, the same for all. Up to ``limit`` rows
    of a key are held; a key with more stays as it is.
    """

    def rows(key: np.ndarray, cid: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(cid), pa.array(first)], names=["key", "cid", "first"])

    def groups(key: np.ndarray, cid: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key):
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            members = np.add.reduceat(_spread(cid.astype(np.uint64), _LANES[:1])[:, 0], starts)
            new = np.zeros(len(starts), bool)
            new[np.unique(members, return_index=True)[1]] = True
            give = np.repeat(new & (sizes > 1), sizes)
            first = np.repeat(np.minimum.reduceat(cid, starts), sizes)
            yield rows(np.repeat(members, sizes)[give].view(np.int64), cid[give], first[give])

    @gives_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cid, crowded, head = np.zeros(0, np.int64), np.zeros(0, np.int64), None, 0
        for batch in batches:
            more = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]
            key, cid = np.append(key, more[0]), np.append(cid, more[1])
            if crowded is not None:
                own = key == crowded
                yield rows(key[own], cid[own], np.full(own.sum(), head))
                key, cid = key[~own], cid[~own]
            if not len(key):
                continue
            last = np.searchsorted(key, key[-1])  # its rows may go on in the next batch
            yield from groups(key[:last], cid[:last])
            key, cid = key[last:], cid[last:]
            if len(key) > limit:
                crowded, head = key[0], cid.min()
                yield rows(key, cid, np.full(len(key), head))
                key, cid = key[:0], cid[:0]
        yield from groups(key, cid)

    return run


@F.arrow_udf(IntegerType())
def _distance(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The differing bits of two sketches."""
    for a, b in batches:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) for c in (a, b))
        yield pa.array(np.bitwise_count(x ^ y).sum(axis=1).astype(np.int32))


def forest(ids: np.ndarray, sketches: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links (``most`` differing bits) among distinct ids."""
    a, b = [], []
    left = np.arange(len(ids))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            p = front.pop()
            hit = np.bitwise_count(sketches[left] ^ sketches[p]).sum(axis=1) <= most
            if hit.any():
                found = left[hit]
                a.append(np.full(len(found), ids[p]))
                b.append(ids[found])
                front.extend(found.tolist())
                left = left[~hit]
    return a, b


def _verified(most: int, width: int, members: bool = False):
    """Rows ``key, cid, sketch`` sorted by key to links ``a, b``; one key's rows are held.

    ``width`` is the sketch's bytes. With ``members`` the result is ``key, cid``,
    the rows that have a link.
    """

    def links(key: int, ids: list[np.ndarray], sketches: list[bytes]) -> Iterator[pa.RecordBatch]:
        whole, first = np.unique(np.concatenate(ids), return_index=True)
        if len(whole) > 1:
            rows = np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, width // 8)[first]
            a, b = forest(whole, rows, most)
            if a and members:
                linked = np.unique(np.concatenate(a + b))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(linked), key, np.int64)), pa.array(linked)], names=["key", "cid"])
            elif a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    @gives_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sketches = None, [], []
        for batch in batches:
            key, cid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if not len(key):
                continue
            raw = b"".join(batch.column(2).to_pylist())
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).tolist()
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if key[i] != at:
                    if ids:
                        yield from links(at, ids, sketches)
                    at, ids, sketches = key[i], [], []
                ids.append(cid[i:j])
                sketches.append(raw[width * i : width * j])
        if ids:
            yield from links(at, ids, sketches)

    return run


def _in_blocks(shared: DataFrame, limit: int) -> DataFrame:
    """Keys with over ``limit`` rows are dealt into blocks, and each pair of blocks gets a key.

    So any two of a key's rows still meet, in some task, and no task holds more
    than about ``limit`` of them.
    """
    crowded = shared.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    if crowded.isEmpty():
        return shared
    joined = shared.join(crowded, F.col("key") == F.col("k"), "left")
    blocks = F.ceil(F.col("n") * 2 / limit).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks)
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    return joined.select(F.explode(F.when(F.col("n").isNull(), F.array("key")).otherwise(pairs)).alias("key"), "cid")


def fingerprint_links(rows: DataFrame, classes: DataFrame, limit: int = 16384) -> DataFrame:
    """``a, b``: links among ``classes`` (``cid, sig``) by the fingerprints of ``rows`` (``sig, fp``).

    Rows whose fingerprints differ in three bits or fewer are in one component; see
    :func:`link_fingerprints`. Each distinct fingerprint stands for the smallest class that has it.
    """
    sig = classes.select(F.col("sig").alias("s"), "cid")
    prints = materialize(rows.select("sig", "fp").distinct().join(sig, F.col("sig") == F.col("s")).select("fp", "cid"))
    least = materialize(prints.groupBy(F.col("fp").alias("p")).agg(F.min("cid").alias("c")))
    same = prints.join(least, F.col("fp") == F.col("p")).where("cid <> c").select(F.col("cid").alias("a"), F.col("c").alias("b"))
    end = lambda p, c: least.select(F.col("p").alias(p), F.col("c").alias(c))
    near = link_fingerprints(least.select("p"), limit)
    near = near.join(end("p1", "c1"), F.col("a") == F.col("p1")).join(end("p2", "c2"), F.col("b") == F.col("p2"))
    return materialize(same.unionByName(near.where("c1 <> c2").select(F.col("c1").alias("a"), F.col("c2").alias("b"))))


def _apart(shared: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``shared`` whose key has members in several components of ``links``."""
    root = F.coalesce("root", "cid").alias("root")
    tagged = shared.join(components(links), F.col("cid") == F.col("node"), "left").select(*shared.columns, root)
    tagged = materialize(tagged)
    apart = tagged.groupBy(F.col("key").alias("k")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("k")
    return materialize(tagged.join(apart, F.col("key") == F.col("k")).select(*shared.columns))


def near_copy_links(classes: DataFrame, known: DataFrame, limit: int = 16384, most: int = MOST_BITS) -> DataFrame:
    """``a, b``: ``known`` links and verified ones among ``classes`` (``cid, sig``, both distinct, and ``keys``).

    Keys within one component of ``known`` are left out. A key's members give a spanning forest of the verified links among them, not
    pairs. Keys that one class alone has are dropped before signatures move, and
    keys of the same classes are one. Stars are verified first; what lies in one
    component by them is left out. Of the rest, a part of the sketch leaves out chance
    meetings before whole sketches move.
    """
    keyed = classes.select(F.explode("keys").alias("key"), "cid")
    dealt = keyed.repartition(F.col("key")).sortWithinPartitions("key")
    shared = materialize(dealt.mapInArrow(_shared(limit), "key long, cid long, first long").distinct())
    shared = _apart(shared, known)

    sig = lambda c, s: classes.select(F.col("cid").alias(c), F.col("sig").alias(s))
    stars = shared.select("first", "cid").where("first <> cid").distinct()
    stars = stars.join(sig("c1", "s1"), F.col("first") == F.col("c1")).join(sig("c2", "s2"), F.col("cid") == F.col("c2"))
    stars = stars.where(_distance("s1", "s2") <= most).select(F.col("first").alias("a"), F.col("cid").alias("b"))
    known = known.unionByName(materialize(stars))
    rows = _in_blocks(_apart(shared, known).select("key", "cid"), limit)

    def met(of: DataFrame, width: int) -> DataFrame:
        sketch = classes.select(F.col("cid").alias("c"), F.substring("sig", 1, width).alias("sketch"))
        joined = of.join(sketch, F.col("cid") == F.col("c")).select("key", "cid", "sketch")
        return joined.repartition(F.col("key")).sortWithinPartitions("key")

    near = materialize(met(rows, COARSE).mapInArrow(_verified(COARSE_BITS, COARSE, members=True), "key long, cid long"))
    return known.unionByName(met(near, SKETCH).mapInArrow(_verified(most, SKETCH), "a long, b long"))


def keep_one_of_each(docs: DataFrame, limit: int = 16384) -> DataFrame:
    """``docs`` with one row of each group of near-copies, all columns as they are.

    Near-copies have fingerprints within three bits (:func:`fingerprint_links`) or share about
    four fifths of their five-word shingles or more (``MOST_BITS``); groups are chains of such links. The row with the smallest
    ``doc_id`` stays (a null id comes last; equal ids are told apart by their
    text's hash). Of rows with equal id and text, one stays; rows of one id whose
    texts are no near-copies all stay. Texts without words are copies of each
    other. Equal signatures are one class from the start, so a large group of
    copies is one row from then on. An empty table stays empty. Only numbers of rows
    are dealt about; the texts of the rows that stay are read once more at the end.
    """
    part, place = fresh(docs, "_part"), fresh(docs, "_place")
    placed = read_order(docs, part, place)
    rows = placed.select(F.col(part).alias("part"), F.col(place).alias("place"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text")
    rows = materialize(signatures(rows))
    order = F.struct(F.col("d").isNull().alias("n"), "d", "h", "part", "place")
    classes = rows.groupBy("sig").agg(F.min(order).alias("first"), F.first("keys").alias("keys")).withColumn("cid", F.monotonically_increasing_id())
    classes = materialize(classes)
    rooted = components(near_copy_links(classes, fingerprint_links(rows, classes, limit), limit))
    named = classes.join(rooted, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    first = named.groupBy("root").agg(F.min("first").alias("first"))
    keep = first.select(F.col("first.part").alias("keep_part"), F.col("first.place").alias("keep_place"))
    gone = rows.join(keep, (F.col("part") == F.col("keep_part")) & (F.col("place") == F.col("keep_place")), "left_anti")
    gone_part, gone_place = fresh(placed, "_gone_part"), fresh(placed, "_gone_place")
    gone = materialize(gone.select(F.col("part").alias(gone_part), F.col("place").alias(gone_place)))
    stay = placed.join(gone, (F.col(part) == F.col(gone_part)) & (F.col(place) == F.col(gone_place)), "left_anti")
    return stay.drop(part, place)
