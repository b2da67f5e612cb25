"""Ordered work on keys of any size: the rows are cut into ranges of the order.

A window over a whole key puts a hot key into one task. Here rows are dealt to
ranges of the order first, so a key's rows are in many tasks; windows run inside a
key's part of a range, and what a part needs of those before or after it comes
from a table with one row for each key and range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewright.sources.shared import materialize

#: Rows of a range, about.
EACH = 1_000_000


def ranged(rows: DataFrame, order: Sequence[str], out: str = "_range", each: int = EACH) -> DataFrame:
    """``rows`` with the number of their range, which never falls along ``order``.

    The number of ranges follows the number of rows. The result is written to the
    shared folder: a second look at it finds the same ranges.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))
    return materialize(rows.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id()))


def upto(keys: Sequence[str], order: Sequence, out: str = "_range") -> WindowSpec:
    """A key's rows in one range, up to a row."""
    return Window.partitionBy(*keys, out).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def earlier(keys: Sequence[str], out: str = "_range") -> WindowSpec:
    """The ranges of a key before a range, of rows that are a key's ranges."""
    return Window.partitionBy(*keys).orderBy(out).rowsBetween(Window.unboundedPreceding, -1)


def later(keys: Sequence[str], out: str = "_range") -> WindowSpec:
    """The ranges of a key after a range, the nearest last."""
    return Window.partitionBy(*keys).orderBy(F.desc(out)).rowsBetween(Window.unboundedPreceding, -1)


def carried(
    rows: DataFrame, keys: Sequence[str], facts: dict[str, Column], carry: Callable[[DataFrame], DataFrame], take: Sequence[str], out: str = "_range"
) -> DataFrame:
    """``rows`` with the columns ``take`` of what its key's other ranges know.

    ``facts`` are aggregates of a key's part of a range; ``carry`` adds windows over
    the table of them (see :func:`earlier` and :func:`later`). Null keys are a key
    of their own.
    """
    names = [*keys, out]
    known = carry(rows.groupBy(*names).agg(*[c.alias(n) for n, c in facts.items()]))
    known = known.select(*[F.col(n).alias(f"{n}__k") for n in names], *take)
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}__k"))
    return rows.join(known, same).drop(*[f"{n}__k" for n in names])
