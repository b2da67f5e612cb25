"""Connected components of a graph of links, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import materialize


def _smallest(directed: DataFrame) -> DataFrame:
    """``u, v, m``: each link with the smallest of ``u`` and all its neighbours."""
    least = directed.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    return directed.join(least, F.col("u") == F.col("n")).select("u", "v", F.least("m", "u").alias("m"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node with a link.

    ``links`` has ``a`` and ``b`` of one orderable type; direction, repeats and
    links of a node to itself do not matter, nulls are left out. Each round has
    a large-star and a small-star step: a node's larger neighbours, then all its
    smaller ones, are tied to the smallest one around. The rounds needed grow
    with the logarithm of the longest chain. Smallest neighbours are found by
    partial aggregation, so a node with very many links is no large group; the
    links are written to the shared folder after each round. An empty table
    gives an empty one. RuntimeError if ``max_rounds`` do not suffice.
    """
    edges = (
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = materialize(edges)
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _smallest(large).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = materialize(edges)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
