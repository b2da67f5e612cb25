"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

The words of the test items are numbered; a document's words get those numbers,
others none. Where three words in a row are an item's, a seed joins the passage
to the item. Only rare seeds count: the whole corpus is counted, and a seed in
over a thousandth of all documents is left out if it is also in over four times
as many as the item's seeds commonly are. So an item that very many documents
copy keeps its seeds, and edited copies keep those that are left. Around the
seeds a local alignment of words scores how much of the item the passage holds,
in order, with words changed, added or left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import fresh, gives_back

#: Words are runs of letters and digits; every other ASCII character is a space.
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SEED_WORDS = 3
MATCHES = "array<struct<item_id:bigint,score:double,first_word:int,last_word:int>>"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in lower case; none for null."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()


@dataclass
class Items:
    """Test items as word numbers, with an index of their seeds."""

    ids: list[int]
    vocabulary: dict[bytes, int]
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted codes
    first: np.ndarray  # where each code's entries start
    item: np.ndarray
    place: np.ndarray

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words_of(text)], np.int64)

    def codes(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of three known words in a row, and their codes."""
        if len(numbers) < SEED_WORDS:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = numbers >= 0
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        size = len(self.vocabulary)
        return at, (numbers[at] * size + numbers[at + 1]) * size + numbers[at + 2]

    def found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``codes`` are seeds, and the seeds' numbers."""
        if not len(self.seeds) or not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.seeds, codes), len(self.seeds) - 1)
        hit = np.flatnonzero(self.seeds[at] == codes)
        return hit, at[hit]


def index(rows: list[tuple[int, str | None]], spread: dict[int, int] | None = None) -> Items:
    """Index items; with ``spread`` (documents by seed code, all under -1) only their rare seeds.

    Items of fewer than three words, null and empty ones are left out: no
    passage can be told from chance by them.
    """
    vocabulary: dict[bytes, int] = {}
    ids, words = [], []
    for item, text in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")):
        found = words_of(text)
        if len(found) >= SEED_WORDS:
            ids.append(item)
            words.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found], np.int64))
    out = Items(ids, vocabulary, words, *(np.zeros(0, np.int64) for _ in range(4)))
    entries = []
    for i, numbers in enumerate(words):
        at, codes = out.codes(numbers)
        if spread is not None:
            held = np.array([spread.get(c, 0) for c in codes.tolist()])
            some = np.sort(held[held > 0])
            usual = some[len(some) // 2] if len(some) else 0
            rare = (held > 0) & ((held <= 4 * usual) | (held * 1000 <= spread.get(-1, 0)))
            at, codes = at[rare], codes[rare]
        entries.append(np.stack([codes, np.full(len(at), i), at], axis=1))
    if entries:
        table = np.concatenate(entries)
        table = table[np.lexsort(table.T[::-1])]
        out.seeds, out.first = np.unique(table[:, 0], return_index=True)
        out.first = np.append(out.first, len(table))
        out.item, out.place = table[:, 1], table[:, 2]
    return out


def align(passages: np.ndarray, item: np.ndarray, miss: float = 0.5, gap: float = 0.5) -> tuple[np.ndarray, ...]:
    """Smith-Waterman: the best score of an item in each passage, and where it ends.

    ``passages`` is a matrix of word numbers (below 0: fits nothing). A word
    that fits scores 1; one that does not, is added or left out costs a half.
    """
    n, width = passages.shape
    row = np.zeros((n, width + 1), np.float32)
    ramp = np.arange(width + 1, dtype=np.float32) * gap
    best, end = np.zeros(n, np.float32), np.zeros(n, np.int64)
    for word in item:
        step = np.where(passages == word, np.float32(1), np.float32(-miss))
        new = np.maximum(row - gap, 0)
        new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + step)
        row = np.maximum.accumulate(new + ramp, axis=1) - ramp
        at = row.argmax(axis=1)
        top = row[np.arange(n), at]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at - 1, end)
    return best, end


def needed(n_words: int, share: float) -> float:
    """The score from which a passage counts: ``share`` of the words, 6 at least or all."""
    return max(share * n_words, min(n_words, 6))


def _windows(places: np.ndarray, reach: int, length: int) -> Iterator[tuple[int, int]]:
    """Stretches of words around seeds; seeds further apart than ``reach`` have their own."""
    places = np.sort(places)
    for part in np.split(places, np.flatnonzero(np.diff(places) > reach) + 1):
        at, last = int(part[0]), int(part[-1])
        while last - at > 8 * reach:  # a long row of seeds: overlapping stretches
            yield max(0, at - reach), min(length, at + 7 * reach + SEED_WORDS)
            at += 5 * reach
        yield max(0, at - reach), min(length, last + SEED_WORDS + reach)


def matches(items: Items, numbers: list[np.ndarray], share: float, cells: int = 1 << 20) -> list[dict[int, tuple]]:
    """For each document the items it holds: number to (score, first word, last word)."""
    out: list[dict[int, tuple]] = [{} for _ in numbers]
    work: dict[int, list[tuple[int, int, int]]] = {}
    for d, words in enumerate(numbers):
        at, codes = items.codes(words)
        hit, seed = items.found(codes)
        if not len(hit):
            continue
        counts = items.first[seed + 1] - items.first[seed]
        place = np.repeat(at[hit], counts)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        which = items.item[np.repeat(items.first[seed], counts) + inner]
        for i in np.unique(which).tolist():
            reach = len(items.words[i]) + len(items.words[i]) // 2
            for lo, hi in _windows(place[which == i], reach, len(words)):
                work.setdefault(i, []).append((d, lo, hi))
    for i, found in work.items():
        item = items.words[i]
        found.sort(key=lambda x: x[2] - x[1])
        at = 0
        while at < len(found):
            take = max(1, cells // max(1, found[min(len(found), at + 256) - 1][2] - found[min(len(found), at + 256) - 1][1]))
            part = found[at : at + min(take, 256)]
            at += len(part)
            passages = np.full((len(part), max(hi - lo for _, lo, hi in part)), -1, np.int64)
            for r, (d, lo, hi) in enumerate(part):
                passages[r, : hi - lo] = numbers[d][lo:hi]
            score, end = align(passages, item)
            for (d, lo, hi), s, e in zip(part, score.tolist(), end.tolist(), strict=True):
                if s >= needed(len(item), share) and (i not in out[d] or s > out[d][i][0]):
                    # The same alignment backwards tells where it starts.
                    back = np.ascontiguousarray(numbers[d][lo : lo + e + 1][::-1])[None, :]
                    start = lo + e - int(align(back, item[::-1])[1][0])
                    out[d][i] = (s, start, lo + e)
    return out


def item_blocks(items: DataFrame, block_bytes: int = 8 << 20) -> Iterator[list[tuple[int, str]]]:
    """The stated test items in blocks of about ``block_bytes``; the driver holds one at a time."""
    sized = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield [(r.item_id, r.text) for r in sized.where(part == k).distinct().collect()]


def _spread(docs: DataFrame, items: Items) -> dict[int, int]:
    """The number of documents that hold each seed, and of all (-1), summed in tasks and then over them."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    @gives_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        held = np.zeros(len(items.seeds), np.int64)
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for value in batch.column(0):
                held[np.unique(items.found(items.codes(items.numbers(value.as_py()))[1])[1])] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(items.seeds[some], -1)), pa.array(np.append(held[some], rows))], names=["seed", "n"])

    counted = docs.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    found = {r.seed: r.n for r in counted.collect()}
    sent.destroy()
    return found


def _matching(sent, share: float):
    @F.arrow_udf(MATCHES)
    @gives_back
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = sent.value
        kind = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())])
        for column in batches:
            out: list[list[dict]] = []
            group: list[np.ndarray] = []
            size = 0

            def close(out=out):
                for found in matches(items, group, share):
                    out.append(
                        [{"item_id": items.ids[i], "score": s, "first_word": a, "last_word": b} for i, (s, a, b) in sorted(found.items())]
                    )

            for value in column:
                group.append(items.numbers(value.as_py()))
                size += len(group[-1])
                if size > 500_000:
                    close()
                    group, size = [], 0
            close()
            yield pa.array(out, pa.list_(kind))

    return run


def with_matches(docs: DataFrame, benchmark: DataFrame, out: str, share: float = 0.4, block_bytes: int = 8 << 20) -> DataFrame:
    """Add the array ``out`` of the test items that each document's text holds.

    Each has ``item_id``, ``score`` (words in order that fit, less a half for
    each changed, added or missing one) and the passage's first and last word.
    An item is held if the score is ``share`` of its words or more (6 words at
    least; all of a shorter item). Whole texts are searched, of any length; null
    and empty texts hold nothing. The test items are a stated query set, repeated
    rows of it count once: blocks of a bounded size are indexed and broadcast one
    after another, and every block meets all rows in one narrow pass to count its
    seeds and one to align, without shuffling texts. Rows stay as they are.
    """
    found: list[Column] = []
    for block in item_blocks(benchmark, block_bytes):
        everything = index(block)
        if everything.ids:
            sent = docs.sparkSession.sparkContext.broadcast(index(block, _spread(docs, everything)))
            found.append(_matching(sent, share)(F.col("text")))
    empty = F.array().cast(MATCHES)
    return docs.withColumn(out, F.concat(*found) if found else empty)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, share: float = 0.4) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word`` of the items that documents hold."""
    rows = with_matches(docs.select("doc_id", "text"), benchmark, "_m", share)
    return rows.select("doc_id", F.explode("_m").alias("m")).select("doc_id", "m.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.4) -> DataFrame:
    """``docs`` without the rows that hold a test item, all columns as they are."""
    m = fresh(docs, "_m")
    return with_matches(docs, benchmark, m, share).where(F.size(m) == 0).drop(m)
