"""Sharding by balanced label propagation.

Documents that share a hub (equal texts, or any group a caller names) are
linked. Rows are dealt in their order, one to each shard in each turn, so the
counts are at most one apart and the shards, read side by side, give that order
again. In each round the rows of a hub learn, by a join with the hub's counts by
shard, the shard that holds most of the hub and still has room, and ask to move
there. Moves are admitted as swaps: as many rows go from ``a`` to ``b`` as come
from ``b`` to ``a``, first rows that ask to, then rows without links, which lose
nothing. So every round keeps every shard's count, and cut links only fall, until
nothing may move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import distributed_rank, fresh, materialize, read_order, salts_for


def _hub_counts(linked: DataFrame, shards: int) -> DataFrame:
    """``hub, held``: a hub's number of rows in each shard, pre-aggregated."""
    held = [F.count(F.when(F.col("shard") == s, 1)) for s in range(shards)]
    return linked.groupBy("hub").agg(F.array(*held).alias("held"))


def _admitted(asked: dict[tuple[int, int], int], free: list[int]) -> tuple[dict, dict]:
    """How many asking rows move, and how many free rows move in exchange.

    Both are by (from, to). Shards are few and fixed, so these tables have a
    fixed size.
    """
    movers, fillers = {}, {}
    left = list(free)
    for (a, b), n in sorted(asked.items()):
        back = asked.get((b, a), 0)
        swapped = min(n, back)
        extra = min(n - swapped, left[b])
        left[b] -= extra
        if swapped + extra:
            movers[a, b] = swapped + extra
        if extra:
            fillers[b, a] = extra
    return movers, fillers


def _dealt(at: str, shards: int) -> Column:
    """The shard of the row at place ``at``: each run of ``shards`` rows has one in each.

    Runs start at shards by a hash of their number, so that a pattern of rows that
    repeats does not put one kind of row into one shard.
    """
    first = F.pmod(F.xxhash64(F.expr(f"{at} div {shards}")), F.lit(shards))
    return ((F.col(at) + first) % shards).cast("int")


def propagate(rows: DataFrame, shards: int = 24) -> DataFrame:
    """Assign ``shard`` to ``rows`` (``rid``, from 0 without gaps; a nullable ``hub``).

    A null hub has no links. Counts of shards differ by one at most after each
    round. A hub with more rows than a shard holds spreads over several: a shard
    that it fills takes no more of it. All of a hub's rows that move in a round move
    to one shard, the one that has most of it, so the sum of the squares of the hubs'
    counts grows with each move: the rounds end, and they do when nothing may move.
    An empty table stays empty.
    """
    salts = salts_for(rows.count())
    rows = rows.select("rid", "hub", _dealt("rid", shards).alias("shard"))
    # Written first, so that the join has two plain sides and Spark can split a hub's rows.
    sizes = materialize(rows.groupBy("hub").agg(F.count(F.lit(1)).alias("hub_rows")).where("hub is not null and hub_rows > 1"))
    rows = materialize(
        rows.join(sizes.withColumnRenamed("hub", "h"), F.col("hub") == F.col("h"), "left")
        .withColumn("hub", F.when(F.col("hub_rows").isNotNull(), F.col("hub")))
        .select("rid", "hub", "shard")
    )
    quota = {r.shard: r.n for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    room = F.array(*[F.lit(quota.get(s, 0)).cast("long") for s in range(shards)])
    while True:
        linked = rows.where("hub is not null")
        # Most rows of the hub, then the lowest shard; a shard that the hub fills is closed.
        best = F.array_max(
            F.zip_with(
                F.transform("held", lambda x, i: F.struct(x.alias("held"), (-i).alias("s"))),
                room,
                lambda x, most: F.when((x["held"] < most) & (x["held"] > 0), x),
            )
        )
        wish = (
            _hub_counts(linked, shards)
            .withColumn("room", room)
            .withColumn("target", (-best["s"]).cast("int"))
            .withColumn("closed", F.expr(f"transform(sequence(0, {shards - 1}), i -> held[i] >= room[i])"))
            .where("target is not null")
            .select(F.col("hub").alias("h"), "target", "closed")
        )
        wish = materialize(wish)  # as above
        asking = (
            linked.join(wish, F.col("hub") == F.col("h"))
            .where((F.col("target") != F.col("shard")) & ~F.get("closed", F.col("shard")))
            .select("rid", "shard", "target")
        )
        asking = materialize(asking)
        asked = {(r.shard, r.target): r.n for r in asking.groupBy("shard", "target").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not asked:
            break
        loose = rows.where("hub is null")
        free = {r.shard: r.n for r in loose.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        movers, fillers = _admitted(asked, [free.get(s, 0) for s in range(shards)])
        if not movers:
            break
        spark = rows.sparkSession
        most = spark.createDataFrame([(a, b, n) for (a, b), n in movers.items()], "a int, b int, most long")
        moved = (
            distributed_rank(asking, ["shard", "target"], [F.col("rid")], [F.col("rid")], "n", salts)
            .join(F.broadcast(most), (F.col("shard") == F.col("a")) & (F.col("target") == F.col("b")))
            .where("n < most")
            .select("rid", F.col("b").alias("to_shard"))
        )
        if fillers:
            # Rows without links in a shard, in order: so many to this shard, so many to that.
            spans, at = [], {}
            for (a, b), n in sorted(fillers.items()):
                spans.append((a, at.get(a, 0), at.get(a, 0) + n, b))
                at[a] = at.get(a, 0) + n
            spans_df = spark.createDataFrame(spans, "a int, lo long, hi long, b int")
            needed = spark.createDataFrame(list(at.items()), "a int, need long")
            # The first number of each sub-group is all that is needed to leave most rows out.
            ranked = distributed_rank(
                loose.join(F.broadcast(needed), F.col("shard") == F.col("a"), "left_semi"),
                ["shard"], [F.col("rid")], [F.col("rid")], "n", salts,
            )
            filled = ranked.join(
                F.broadcast(spans_df),
                (F.col("shard") == F.col("a")) & (F.col("n") >= F.col("lo")) & (F.col("n") < F.col("hi")),
            ).select("rid", F.col("b").alias("to_shard"))
            moved = moved.unionByName(filled)
        rows = materialize(
            rows.join(moved.withColumnRenamed("rid", "r"), F.col("rid") == F.col("r"), "left")
            .withColumn("shard", F.coalesce("to_shard", "shard"))
            .select("rid", "hub", "shard")
        )
    return rows


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Put every row of ``docs`` into a shard; links are equal texts.

    Adds ``size`` (UTF-8 bytes of the text and 8 more; a null text has none),
    ``text_crc32`` (of the UTF-8 bytes; a null text counts as empty), ``law``
    (``rows``: the shards' counts differ by one at most), ``shard`` from 0,
    ``slot`` (the row's number in its shard, from 0 without gaps, in the order
    of ``docs``: of files by name, or else of partitions) and
    ``grown_shard`` (null under this law). Null texts are linked to each other.
    Repeated rows are rows of their own. Columns of ``docs`` with these names,
    in any case, are replaced; all others stay as they are. Which of equally good
    rows moves is arbitrary but fixed once written. Decisions are made on numbers of
    rows, without texts, and joined back.
    """
    made = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    part, place = fresh(docs, "_part"), fresh(docs, "_place")
    own = [F.col(f"`{c}`") for c in docs.columns]
    placed_docs = read_order(docs, part, place)
    rows = placed_docs.select(
        F.col(part).alias("part"),
        F.col(place).alias("place"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.xxhash64("text", F.lit(0)).alias("hub"),
    )
    rows = materialize(rows)
    # One row a file: the rows of the files before it.
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    parts = materialize(parts.select(F.col("part").alias("of"), "before"))
    rows = rows.join(parts, F.col("part") == F.col("of")).withColumn("id", (F.col("before") + F.col("place")).cast("long"))
    placed = propagate(rows.select(F.col("id").alias("rid"), "hub"), shards)
    n = placed.count()
    ranges = F.floor(F.col("rid") * F.lit(salts_for(-(-n // shards))) / F.lit(max(1, n))).cast("int")
    placed = distributed_rank(placed.select("rid", "shard"), ["shard"], [F.col("rid")], [], "slot", ranges=ranges)
    decided = rows.join(placed, F.col("id") == F.col("rid")).select(
        F.struct("part", "place").alias("_of"),
        F.struct("size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")).alias("_made"),
    )
    of, got = fresh(placed_docs, "_of"), fresh(placed_docs, "_made")
    decided = materialize(decided.select(F.col("_of").alias(of), F.col("_made").alias(got)))
    joined = placed_docs.join(decided, (F.col(part) == F.col(f"{of}.part")) & (F.col(place) == F.col(f"{of}.place")))
    return joined.select(*own, *[F.col(f"{got}.{c}").alias(c) for c in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")])
