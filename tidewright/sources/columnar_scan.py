"""Columnar tables of any size, read by ranges of bytes and put together by ranges of rows.

A table is a JSON object with an array for each column. Commas one level down part its
columns and those two levels down its cells; how deep a comma lies depends on what comes
before the split it is in, so a first pass sums up each split for every depth it may start
at (:mod:`tidewright.sources.json_scan` says how), and a second one gives each cell the
number of its column and row. Cells then meet by ranges of rows, so that no task and no value holds a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators.restore import elements, kind, members
from tidewright.sources.json_scan import Bytes, runs_of_splits, split_starts

#: Rows that are put together at a time.
ROWS = 1000
_STATE = "path string, block bigint, quotes bigint, outside bigint, inside bigint, marks array<struct<inside: boolean, depth: bigint, members: bigint, cells: bigint>>"
_CELLS = "path string, block bigint, seq bigint, member bigint, cell bigint, texts array<string>, opens boolean, closes boolean, open_left boolean, open_right boolean"


def _marks(b: Bytes, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Commas outside strings, and the depth of each from where the bytes start."""
    depth = b.depths(inside)
    at = np.flatnonzero((b.data == 44) & (b.inside == inside))
    return at, depth[at]


def _summary(marks: dict[int, list[int]], depths: np.ndarray) -> None:
    """Add commas to ``marks``: of each depth how many there are, and how many one deeper since the last of them."""
    for d in np.unique(depths).tolist():
        mine = marks.setdefault(d, [0, 0])
        mine[0] += int((depths == d).sum())
        marks.setdefault(d - 1, [0, 0])
    for d, mine in marks.items():
        last = np.flatnonzero(depths == d)
        after = depths[last[-1] :] if len(last) else depths
        mine[1] = int((after == d + 1).sum()) + (0 if len(last) else mine[1])


def _states(rows: DataFrame) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, quotes, change, marks = None, 0, [0, 0], ({}, {})

        def made() -> pa.RecordBatch:
            found = [{"inside": bool(k), "depth": d, "members": n, "cells": c} for k in (0, 1) for d, (n, c) in marks[k].items()]
            types = [("inside", pa.bool_()), ("depth", pa.int64()), ("members", pa.int64()), ("cells", pa.int64())]
            columns = [pa.array([x]) for x in (*key, quotes, *change)] + [pa.array([found], pa.list_(pa.struct(types)))]
            return pa.RecordBatch.from_arrays(columns, names=["path", "block", "quotes", "outside", "inside", "marks"])

        for path, block, first, data in runs_of_splits(stream, 44):
            if first:
                if key is not None:
                    yield made()
                key, quotes, change, marks = (path, block), 0, [0, 0], ({}, {})
            b = Bytes(data)
            for k in (0, 1):
                inside = bool((quotes + k) & 1)
                _summary(marks[k], _marks(b, inside)[1] + change[k])
                change[k] += b.change(inside)
            quotes += b.quotes
        if key is not None:
            yield made()

    return rows.mapInArrow(run, _STATE)


def _starts(states: DataFrame) -> DataFrame:
    """Where each split starts: in a string or not, how deep, and in which column and cell."""
    known = split_starts(states).select(F.col("path").alias("_p"), F.col("block").alias("_b"), "in_string", "depth")
    both = states.join(known, (F.col("path") == F.col("_p")) & (F.col("block") == F.col("_b")))
    mine = F.get(F.filter("marks", lambda m: (m["inside"] == F.col("in_string")) & (m["depth"] + F.col("depth") == 1)), F.lit(0))
    counted = both.select("path", "block", "in_string", "depth", F.coalesce(mine["members"], F.lit(0)).alias("m"), F.coalesce(mine["cells"], F.lit(0)).alias("c"), "marks")
    # Without a comma between columns a split's cells all go on with the column before.
    deeper = F.get(F.filter("marks", lambda m: (m["inside"] == F.col("in_string")) & (m["depth"] + F.col("depth") == 2)), F.lit(0))
    counted = counted.withColumn("c", F.when(F.col("m") > 0, F.col("c")).otherwise(F.coalesce(deeper["members"], F.lit(0)))).drop("marks")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    member = F.coalesce(F.sum("m").over(before), F.lit(0))
    sums = counted.withColumn("member", member).withColumn("_upto", F.coalesce(F.sum("c").over(before), F.lit(0)))
    # Cells before a split since its column began: sums since the last split that began one.
    since = F.last(F.when(F.col("m") > 0, F.col("_upto")), ignorenulls=True).over(before)
    return sums.select("path", "block", "in_string", "depth", "member", (F.col("_upto") - F.coalesce(since, F.lit(0))).alias("cell"))


def _cells(rows: DataFrame, starts: dict) -> DataFrame:
    """Runs of cells of one column and range of rows, and, each a row of its own, what begins or ends a column or is cut by a split."""
    shared = rows.sparkSession.sparkContext.broadcast(starts)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seq, odd, depth, member, cell, opens, left = None, [], 0, False, 0, 0, 0, False, False
        out: list[tuple] = []

        def put(texts: list[bytes], closes: bool, right: bool, m: int, c: int, o: bool, l: bool) -> None:  # noqa: E741
            nonlocal seq
            out.append((*key, seq, m, c, [t.decode("utf-8", "replace") for t in texts], o, closes, l, right))
            seq += 1

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), *[pa.int64()] * 4, pa.list_(pa.string()), *[pa.bool_()] * 4]
            names = [c.split()[0] for c in _CELLS.split(", ")]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return made

        for path, block, first, data in runs_of_splits(stream, 44):
            if first:
                if key is not None:
                    put([b"".join(held)], False, True, member, cell, opens, left)
                key, held, seq = (path, block), [], 0
                odd, depth, member, cell = shared.value[key]
                opens, left = block == 0, block > 0
            b = Bytes(data)
            at, deep = _marks(b, odd)
            deep = deep + depth
            depth += b.change(odd)
            odd ^= bool(b.quotes & 1)
            keep = (deep == 1) | (deep == 2)
            at, deep = at[keep], deep[keep]
            if not len(at):
                held.append(data.tobytes())
                continue
            held.append(data[: at[0]].tobytes())
            put([b"".join(held)], bool(deep[0] == 1), False, member, cell, opens, left)
            left = False
            # The column and cell that begins after each comma; the last one goes on.
            place = np.arange(len(at))
            opened = np.maximum.accumulate(np.where(deep == 1, place, -1))
            in_member = member + np.cumsum(deep == 1)
            in_cell = np.where(opened >= 0, place - opened, cell + place + 1)
            alone = (deep[:-1] == 1) | (deep[1:] == 1)
            step = np.ones(len(alone), bool)
            step[1:] = alone[1:] | alone[:-1] | (in_cell[1:-1] % ROWS == 0)
            groups = np.append(np.flatnonzero(step), len(alone))
            for i, j in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
                texts = [data[x + 1 : y].tobytes() for x, y in zip(at[i:j], at[i + 1 : j + 1], strict=True)]
                put(texts, bool(deep[j] == 1 and alone[i]), False, int(in_member[i]), int(in_cell[i]), bool(deep[i] == 1), False)
            member, cell, opens = int(in_member[-1]), int(in_cell[-1]), bool(deep[-1] == 1)
            held = [data[at[-1] + 1 :].tobytes()]
            if len(out) > 500:
                yield batch()
        if key is not None:
            put([b"".join(held)], False, True, member, cell, opens, left)
        if out:
            yield batch()

    return rows.mapInArrow(run, _CELLS)


def _whole_cells(cells: DataFrame) -> DataFrame:
    """``path, member, cell, texts, opens, closes`` with cells that splits cut put together."""
    is_open = F.col("open_left") | F.col("open_right")
    order = ["block", "seq"]
    runs = cells.where(is_open).withColumn("_run", F.count_if(~F.col("open_left")).over(Window.partitionBy("path").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    parts = runs.groupBy("path", "_run").agg(F.sort_array(F.collect_list(F.struct(*order, F.col("texts")[0].alias("text"), "member", "cell", "opens", "closes", "open_right"))).alias("p"))
    text, last = F.array_join(F.transform("p", lambda x: x["text"]), ""), F.element_at("p", -1)
    first = F.col("p")[0]
    # What the end of a file leaves open closes its column.
    joined = parts.select("path", first["member"].alias("member"), first["cell"].alias("cell"), F.array(text).alias("texts"), first["opens"].alias("opens"), (last["closes"] | last["open_right"]).alias("closes"))
    return cells.where(~is_open).select("path", "member", "cell", "texts", "opens", "closes").unionByName(joined)


class ColumnarScan:
    """The rows of columnar tables, a JSON object a file.

    Making it runs the pass that finds each split's state; the driver gets a row a split. Columns that are no
    arrays are left out, rows are as many as the shortest column has, and ``__ENUM__``
    has dictionaries, as in :func:`tidewright.operators.restore.columnar_rows`.
    """

    def __init__(self, spark: SparkSession, paths: str | list[str]):
        read = spark.read.option("lineSep", ",").text(paths)
        text = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
        splits = _starts(_states(text)).collect()
        cells = _whole_cells(_cells(text, {(r.path, r.block): (r.in_string, r.depth, r.member, r.cell) for r in splits}))
        name = F.when(F.col("opens"), F.regexp_extract(F.col("texts")[0], r'(?s)^[\s{]*("(?:[^"\\]|\\.)*")\s*:', 1))
        rest = F.when(F.col("opens"), F.regexp_replace(F.col("texts")[0], r'(?s)^[\s{]*"(?:[^"\\]|\\.)*"\s*:\s*', ""))
        self.cells = cells.withColumn("name", F.try_variant_get(F.try_parse_json(name), "$", "string")).withColumn("rest", rest)

    def columns(self) -> DataFrame:
        """``path, member, name, is_array, cells`` of each column; a row a column."""
        size = F.col("cell") + F.size("texts")
        empty = F.col("opens") & F.col("closes") & F.col("rest").rlike(r"^\[\s*\]\s*}?\s*$")
        return self.cells.groupBy("path", "member").agg(
            F.max("name").alias("name"), F.max(F.startswith("rest", F.lit("["))).alias("is_array"), F.when(F.max(empty), 0).otherwise(F.max(size)).alias("cells")
        )

    def dictionaries(self) -> DataFrame:
        """``path, name, book``: the words of each column that has a dictionary."""
        mine = self.cells.join(self.columns().where("name = '__ENUM__'").select(F.col("path").alias("_p"), F.col("member").alias("_m")), (F.col("path") == F.col("_p")) & (F.col("member") == F.col("_m")))
        parts = F.sort_array(F.collect_list(F.struct("cell", F.coalesce("rest", F.array_join("texts", ",")).alias("text"))))
        text = F.array_join(F.transform("p", lambda x: x["text"]), ",")
        # The last member's text has the end of the object, if the file ends with it.
        known = mine.groupBy("path").agg(parts.alias("p")).select("path", F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_replace(text, r"}\s*$", ""))).alias("v"))
        return known.select("path", F.explode(members(F.col("v"))).alias("name", "book")).select("path", "name", elements(F.col("book")).alias("book")).where("book is not null")

    def rows(self) -> DataFrame:
        """``path, pos, record``: the rows in their order; ranges of ``ROWS`` of them are put together apart."""
        known = self.columns()
        least = known.where("is_array").groupBy(F.col("path").alias("_p")).agg(F.min("cells").alias("n"))
        used = known.where("is_array and name is not null").join(least, F.col("path") == F.col("_p")).where("n > 0").drop("_p")
        books = self.dictionaries().select(F.col("path").alias("_p"), F.col("name").alias("_name"), "book")
        used = used.join(books, (F.col("path") == F.col("_p")) & (F.col("name") == F.col("_name")), "left").select(F.col("path").alias("_p"), F.col("member").alias("_m"), F.col("name").alias("key"), "n", "book")
        first = F.when(F.col("opens"), F.regexp_replace("rest", r"^\[", "")).otherwise(F.col("texts")[0])
        ends = lambda t: F.when(F.col("closes"), F.regexp_replace(t, r"\]\s*}?\s*$", "")).otherwise(t)
        alone = F.col("opens") | F.col("closes")
        texts = F.when(alone, F.array(ends(first))).otherwise(F.col("texts"))
        some = self.cells.select("path", "member", "cell", texts.alias("texts")).join(used.select("_p", "_m", "n"), (F.col("path") == F.col("_p")) & (F.col("member") == F.col("_m")))
        some = some.where(F.col("cell") < F.col("n")).withColumn("at", F.floor(F.col("cell") / ROWS))
        column = some.groupBy("path", "member", "at", "n").agg(F.sort_array(F.collect_list(F.struct("cell", "texts"))).alias("p"))
        column = column.select("path", "member", "at", F.slice(F.flatten(F.transform("p", lambda x: x["texts"])), F.lit(1), F.least(F.lit(ROWS), F.col("n") - F.col("at") * ROWS).cast("int")).alias("texts"))

        def cell(text: Column) -> Column:
            v = F.try_parse_json(text)
            code = F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))
            held = F.when(~F.coalesce(F.is_variant_null(v), F.lit(True)), v)
            return F.when(F.col("book").isNotNull() & (code >= 0), F.get(F.col("book"), code.cast("int"))).otherwise(held)

        decoded = column.join(used.drop("n"), (F.col("path") == F.col("_p")) & (F.col("member") == F.col("_m"))).select("path", "at", "key", F.transform("texts", cell).alias("values"))
        wide = decoded.groupBy("path", "at").agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("c"))
        size = F.size(F.get(F.map_values("c"), F.lit(0)))
        each = wide.select("path", "at", "c", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
        record = F.to_variant_object(F.transform_values("c", lambda _, a: F.get(a, F.col("i"))))
        return each.select("path", (F.col("at") * ROWS + F.col("i")).alias("pos"), record.alias("record"))
