"""JSON arrays of any size, read in byte ranges: a file is as many tasks as it has splits.

Spark's text reader splits a file anywhere when lines end at ``}``. What a split
does to the state of a reader (inside a string or not, how deep) depends on where it
starts, but only in two ways, inside a string or outside; so each split tells in one pass what it
does in both cases, sums over the splits before say which case holds and at
what depth, and a second pass cuts the split into records. A record over the
edge of splits comes in parts that are put together by their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SPLIT = ["path", "block"]
_STATE = "path string, block bigint, quotes bigint, outside bigint, inside bigint"
_PIECE = "path string, block bigint, seq bigint, text string, open_left boolean, open_right boolean"


def fragments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, block, value``: the texts up to each ``}``, and the split they start in."""
    read = spark.read.option("lineSep", "}").text(paths)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


class Bytes:
    """The bytes of some fragments of one split, with what ended each before it, and what they are made of."""

    def __init__(self, data: np.ndarray):
        self.data = data
        quote = data == 34
        slash = data == 92
        if slash.any():
            # A quote is escaped after an odd number of backslashes.
            at = np.flatnonzero(quote)
            plain = np.where(slash, -1, np.arange(len(data)))
            run = at - 1 - np.maximum.accumulate(plain)[at - 1]
            quote[at[(at > 0) & (run % 2 == 1)]] = False
        self.quotes = int(quote.sum())
        #: Whether a byte is inside a string, for a start outside one; quotes themselves may be either.
        self.inside = (np.cumsum(quote) & 1).astype(bool)
        self.opens = (data == 123) | (data == 91)
        self.closes = (data == 125) | (data == 93)

    def change(self, inside: bool) -> int:
        """How the depth changes over all bytes, for a start inside a string or not."""
        there = self.inside == inside
        return int((self.opens & there).sum()) - int((self.closes & there).sum())

    def depths(self, inside: bool) -> np.ndarray:
        """The depth after each byte, counted from where the bytes start."""
        there = self.inside == inside
        return np.cumsum((self.opens & there).astype(np.int64) - (self.closes & there))

    def edges(self, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where records of the outer array start and where they have ended."""
        there = self.inside == inside
        upto = depth + self.depths(inside)
        starts = np.flatnonzero(there & (self.data == 123) & (upto == 2))
        ends = np.flatnonzero(there & (self.data == 125) & (upto == 1)) + 1
        return starts, ends


def runs_of_splits(stream: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple[str, int, bool, np.ndarray]]:
    """``path, block``, whether it is the first of its split, and bytes, for runs of fragments of one split.

    Before each fragment but a file's first stands the byte ``end``, which ended the one before.
    """
    last = None
    for batch in stream:
        if not batch.num_rows:
            continue
        paths, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        value = batch.column(2).cast(pa.large_binary())
        cuts = [0, *[i for i in range(1, len(paths)) if blocks[i] != blocks[i - 1] or paths[i] != paths[i - 1]], len(paths)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            some = value.slice(i, j - i)
            offsets = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
            raw = some.buffers()[2]
            text = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
            lengths = np.diff(offsets)
            data = np.full(len(text) + len(lengths), end, np.uint8)
            keep = np.ones(len(data), bool)
            keep[np.cumsum(lengths + 1) - lengths - 1] = False
            data[keep] = text
            key = (paths[i], blocks[i])
            if key != last and key[1] == 0:
                data = data[1:]  # nothing ended before the first fragment of a file
            yield *key, key != last, data
            last = key


def split_states(rows: DataFrame) -> DataFrame:
    """Of each split the number of quotes, and the change of depth if it starts outside or inside a string."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, quotes, change = None, 0, [0, 0]
        done: list[tuple] = []
        for path, block, first, data in runs_of_splits(stream, 125):
            if first and key is not None:
                done.append((*key, quotes, *change))
            if first:
                key, quotes, change = (path, block), 0, [0, 0]
            b = Bytes(data)
            for k in (0, 1):
                change[k] += b.change(bool((quotes + k) & 1))
            quotes += b.quotes
        if key is not None:
            done.append((*key, quotes, *change))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "block", "quotes", "outside", "inside"])

    return rows.mapInArrow(run, _STATE)


def split_starts(states: DataFrame) -> DataFrame:
    """``path, block, in_string, depth`` where each split starts, and ``last_string, last_depth`` where its file ends.

    A file is ``fine`` here if it ends outside strings at depth 0. A row a split.
    """
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    first = states.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    moved = first.withColumn("_change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    fine = (F.sum("quotes").over(whole) % 2 == 0) & (F.sum("_change").over(whole) == 0)
    return moved.select("path", "block", "in_string", F.coalesce(F.sum("_change").over(before), F.lit(0)).alias("depth"), fine.alias("fine"))


def _trivial(text: bytes) -> bool:
    """Whether what lies between two records is a comma and white space."""
    return text.strip(b" \t\r\n") == b","


def cut_splits(rows: DataFrame, starts: dict[tuple[str, int], tuple[bool, int]]) -> DataFrame:
    """``path, block, seq, text, open_left, open_right``: records, and what else lies between them, in order.

    Commas between records are left out. Open pieces go on in the split before or after.
    A task holds a batch and the record that it is in.
    """
    shared = rows.sparkSession.sparkContext.broadcast(starts)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seq, open_left, odd, depth = None, [], 0, False, False, 0

        def row(text: bytes, right: bool) -> pa.RecordBatch | None:
            nonlocal seq, open_left
            left, open_left, seq = open_left, False, seq + 1
            if not left and not right and _trivial(text):
                return None
            return made([text], [seq - 1], [left], [right])

        def made(texts, seqs, lefts, rights) -> pa.RecordBatch:
            n = len(seqs)
            columns = [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(seqs, pa.int64())]
            text = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
            columns += [text.cast(pa.string(), safe=False), pa.array(lefts, pa.bool_()), pa.array(rights, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["path", "block", "seq", "text", "open_left", "open_right"])

        def close() -> Iterator[pa.RecordBatch]:
            last = row(b"".join(held), True)
            if last is not None:
                yield last

        for path, block, first, data in runs_of_splits(stream, 125):
            if first:
                if key is not None:
                    yield from close()
                key, held, seq, open_left = (path, block), [], 0, block > 0
                odd, depth = shared.value[key]
            b = Bytes(data)
            begins, ends = b.edges(odd, depth)
            depth += b.change(odd)
            odd ^= bool(b.quotes & 1)
            edges = np.union1d(begins, ends)
            if not len(edges):
                held.append(data.tobytes())
                continue
            held.append(data[: edges[0]].tobytes())
            head = row(b"".join(held), False)
            if head is not None:
                yield head
            for _ in np.intersect1d(begins, ends):  # no comma between two records: no JSON
                yield made([b"!"], [seq - 1], [False], [False])
            if len(edges) > 1:
                # Pieces between edges, without the commas between an end and the next start.
                a, z = edges[:-1], edges[1:]
                record = np.isin(z, ends)
                gaps = ~record
                short = gaps & (z - a == 1) & (data[a] == 44)
                keep = ~short
                texts = [bytes(data[i:j]) for i, j in zip(a[keep], z[keep], strict=True)]
                real = [i for i, (t, r) in enumerate(zip(texts, record[keep], strict=True)) if r or not _trivial(t)]
                seqs = (seq + np.flatnonzero(keep))[real]
                if len(real):
                    yield made([texts[i] for i in real], seqs, [False] * len(real), [False] * len(real))
                seq += len(a)
            held = [data[edges[-1] :].tobytes()]
        if key is not None:
            yield from close()

    return rows.mapInArrow(run, _PIECE)


def stitched(pieces: DataFrame) -> DataFrame:
    """The open ``pieces`` put together, each run of them as one, at the place of its first."""
    order = ["block", "seq"]
    runs = pieces.withColumn("_run", F.count_if(~F.col("open_left")).over(Window.partitionBy("path").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct(*order, "text")))
    whole = runs.groupBy("path", "_run").agg(parts.alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    return whole.select("path", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["seq"].alias("seq"), text.alias("text"))


class ArrayScan:
    """The records of files that are JSON arrays.

    ``pieces`` has ``path, pos, text``: records, and what else than commas lies between them;
    ``pos`` is by the order in the file. Making it runs the pass that finds each split's
    state; the driver gets a row a split.
    """

    def __init__(self, spark: SparkSession, paths: str | list[str]):
        rows = fragments(spark, paths)
        self.splits = split_starts(split_states(rows)).collect()
        cut = cut_splits(rows, {(r.path, r.block): (r.in_string, r.depth) for r in self.splits})
        is_open = F.col("open_left") | F.col("open_right")
        whole = cut.where(~is_open).select("path", "block", "seq", "text").unionByName(stitched(cut.where(is_open)))
        self.pieces = whole.select("path", (F.col("block") + F.col("seq")).alias("pos"), "text").where(~F.col("text").rlike(r"^[ \t\r\n]*,[ \t\r\n]*$"))
        self.spark = spark

    def records(self) -> DataFrame:
        """``path, pos, record``: the objects of the arrays; other elements are skipped, and what cannot be parsed."""
        return self.pieces.where(F.startswith("text", F.lit("{"))).select("path", "pos", F.try_parse_json("text").alias("record")).where("record is not null")

    def status(self) -> DataFrame:
        """``path, ok, rows`` of each file: one that is no JSON array fails, and it alone; an empty file has no row.

        Every record must parse, and so must what lies between the records, put into an array.
        """
        is_record = F.startswith("text", F.lit("{"))
        last = F.max(F.struct("pos", "is_record", "gap"))
        marked = self.pieces.select("path", "pos", is_record.alias("is_record"), F.when(~is_record, F.col("text")).alias("gap"), "text")
        first = F.min(F.struct("pos", "gap"))

        def array(*parts: Column | str) -> Column:
            """Whether the parts are one array; Spark's parser takes no offence at what follows a value, so it stands in another array."""
            outer = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("]"))), "$", "array<variant>")
            return F.coalesce((F.size(outer) == 1) & F.schema_of_variant(F.get(outer, F.lit(0))).startswith("ARRAY"), F.lit(False))

        fine = F.when(is_record, F.try_parse_json("text").isNotNull()).otherwise(array("[0", F.col("gap"), "0]"))
        # The first and the last gap are judged by themselves, below.
        seen = marked.groupBy("path").agg(first.alias("f"), last.alias("l"), F.count_if("is_record").alias("rows"), F.count_if(~fine).alias("bad"))
        f, l = F.col("f.gap"), F.col("l.gap")  # noqa: E741
        one = F.col("f.pos") == F.col("l.pos")
        ends = F.when(one, array(f)).otherwise(array(f, "0]") & array("[0", l))
        among = lambda gap: F.when(array("[0", gap, "0]"), 0).otherwise(1)
        outer = F.when(one, among(f)).otherwise(among(f) + among(l))
        closed = self.spark.createDataFrame([(p,) for p in sorted({r.path for r in self.splits if r.fine})], "_p string")
        ok = F.coalesce(ends, F.lit(False)) & (F.col("bad") == outer) & F.col("_p").isNotNull()
        return seen.join(closed, F.col("path") == F.col("_p"), "left").select("path", ok.alias("ok"), "rows")


def array_scan(spark: SparkSession, paths: str | list[str]) -> ArrayScan:
    return ArrayScan(spark, paths)


def file_stem(path: Column) -> Column:
    """The name of a JSON file without its folder and ending."""
    return F.url_decode(F.regexp_replace(F.regexp_extract(path, r"([^/]*)\.json$", 1), r"\+", "%2B"))
