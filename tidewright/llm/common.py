"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewright.sources.shared import materialize, new_folder, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` has not got, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sub_bucket(cols: Sequence[Column], n: int) -> Column:
    """A stable small number of a row, to split hot groups by."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def salts_for(rows: int, each: int = 50_000) -> int:
    """Sub-groups for :func:`distributed_rank`, so that none has many more than ``each`` rows."""
    return max(64, -(-rows // each))


def distributed_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    salt: Sequence[Column],
    out: str,
    salts: int = 64,
    ranges: Column | None = None,
) -> DataFrame:
    """Number the rows of each group from 0 without holding a group in one task.

    Each group is dealt over ``salts`` sub-groups; the sub-groups' counts, a
    table of at most ``salts`` rows a group, give each sub-group its first
    number, and a window numbers the rows inside it. ``salt`` must tell rows
    apart well; ``order`` fixes the numbers within a sub-group. With ``ranges``, a
    whole number that never falls along ``order``, it names the sub-groups in place
    of ``salt`` and the numbers follow ``order`` throughout. Null keys are a group of
    their own. Rows move once: window and join share their partitioning.
    """
    b, n, off = (fresh(df, x) for x in ("_b", "_n", "_off"))
    plain, parts = df, []
    for k in keys:  # nulls as values, so that the join is by plain equality
        parts += [fresh(df, f"_v_{k}"), fresh(df, f"_u_{k}")]
        plain = plain.withColumn(parts[-2], F.coalesce(F.col(k).cast("string"), F.lit(""))).withColumn(parts[-1], F.col(k).isNull())
    dealt = plain.withColumn(b, sub_bucket(salt, salts) if ranges is None else ranges)
    parts.append(b)
    first = Window.partitionBy(*parts[:-1]).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*parts)
        .agg(F.count(F.lit(1)).alias(n))
        .withColumn(off, F.coalesce(F.sum(n).over(first), F.lit(0)))
        .select(*[F.col(c).alias(f"{c}__o") for c in parts], off)
    )
    ranked = dealt.withColumn(n, F.row_number().over(Window.partitionBy(*parts).orderBy(*order)) - 1)
    same = [F.col(c) == F.col(f"{c}__o") for c in parts]
    return (
        ranked.join(offsets, same)
        .withColumn(out, (F.col(n) + F.col(off)).cast("long"))
        .drop(n, off, *parts, *[f"{c}__o" for c in parts])
    )


def _distinct_files(docs: DataFrame) -> bool:
    """Whether rows come from one table of files, each read once, by projections and filters only."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return False
    try:
        files = plan.relation().location().inputFiles()
    except Py4JError:  # no relation of files
        return False
    return len(files) == len(docs._jdf.inputFiles())  # the latter are distinct; the names stay in the JVM


def read_order(docs: DataFrame, part: str, place: str) -> DataFrame:
    """Add ``part`` and ``place``, which tell rows apart and by which they are in their order.

    They are the files' names and the rows' places in them, however Spark deals
    files to tasks, and the same at each look. Rows that are not of one table of files, or
    of one that has a file twice, are written to the shared folder first. A column
    ``_metadata`` of the table's own is no hindrance.
    """

    def placed(rows: DataFrame) -> DataFrame:
        at = rows.metadataColumn("_metadata")  # the hidden column, whatever the rows' own are called
        return rows.select("*", at["file_path"].alias(part), at["row_index"].alias(place))

    if _distinct_files(docs):
        try:
            return placed(docs)
        except AnalysisException:
            pass  # files without places of rows
    return placed(materialize(docs))


def commonest(counts: DataFrame, n: str, most: int) -> tuple[DataFrame, int, int]:
    """The rows of ``counts`` with the largest ``n``, ``most`` at most, and the sum and number of all.

    Rows are told apart by the logarithm of ``n``, in 64 steps an octave: a
    histogram of a few thousand rows gives the step from which there are
    ``most`` at most. So tasks give up only rows that stay, unlike in a top-k,
    where each task sends its own ``most``. Rows of equal ``n`` stay or go
    together.
    """
    step = fresh(counts, "_step")
    stepped = counts.withColumn(step, F.floor(F.log2(n) * 64).cast("int"))
    steps = stepped.groupBy(step).agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("v")).collect()
    held, least = 0, None
    for r in sorted(steps, key=lambda r: -r[step]):
        held += r.v
        if held > most:
            break
        least = r[step]
    kept = stepped.where(F.lit(False) if least is None else F.col(step) >= least).drop(step)
    return kept, sum(r.n for r in steps), sum(r.v for r in steps)


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of a number's text, modulo ``m``; a null counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8")), F.lit(m))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of an Arrow string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def trim_memory() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and keep it else."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def gives_back(task: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A task's function over batches that ends with :func:`trim_memory`."""

    @functools.wraps(task)
    def run(batches):
        yield from task(batches)
        trim_memory()

    return run


def by_bytes(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row has one of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j
