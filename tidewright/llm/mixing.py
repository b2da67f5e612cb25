"""Mixing sources to target weights by Pfair scheduling.

A source with weight ``c`` out of ``C`` gets its ``j``-th block a release time
``floor(j * C / c)`` and a deadline ``ceil((j + 1) * C / c)``. Earliest deadline
first over the released blocks gives every block a slot inside that window, so
at each slot a source is ahead of or behind its ideal share by less than one
block.

Weights are whole numbers of blocks in a period, so the schedule repeats. While
all sources last each period has the same composition. A source's last, partial
period has as many of its blocks as it has left, and later periods are without
it: period ``f`` holds ``min(q, blocks - f * q)`` blocks of a source with ``q``
a period. The distinct compositions are at most twice the number of sources plus
one; each is scheduled once, by a fold in Spark SQL, and the blocks look their
slots up.

More sources than ``fan`` are dealt into groups, by a hash of their names, and
groups into groups until ``fan`` are left. Each group mixes its own and is one
source to the level above: its ``j``-th block is the ``j``-th of its mixture.
Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import distributed_rank, fresh, materialize, salts_for

#: The fold over one period: takes the sources' block counts ``c`` in a composition and their
#: sum ``total``, gives for each slot the index of its source. A source's state is the number
#: of its next block with that one's release and deadline, so a slot only compares.
_NEXT = "named_struct('done', {k}, 'r', if({k} < {n}, ({k} * total) div {n}, 1152921504606846976L), 'd', if({k} < {n}, (({k} + 1L) * total + {n} - 1L) div {n}, 0L), 'n', {n})"
_EDF = f"""
aggregate(
  sequence(0L, total - 1L),
  named_struct('s', transform(c, n -> {_NEXT.format(k="0L", n="n")}), 'slots', cast(array() as array<int>)),
  (acc, slot) -> element_at(transform(
    array(array_min(transform(acc.s, (x, i) -> if(x.r <= slot, named_struct('d', x.d, 'i', i), null))).i),
    p -> named_struct(
      's', transform(acc.s, (x, i) -> if(i = p, {_NEXT.format(k="(x.done + 1L)", n="x.n")}, x)),
      'slots', array_append(acc.slots, p))
  ), 1),
  acc -> acc.slots
)
"""
#: Elements of a schedule that are broadcast at most; larger ones are joined.
MOST_BROADCAST = 2_000_000


def tempered(blocks, alpha: float):
    """A source's target weight from its size."""
    return F.pow(blocks.cast("double"), F.lit(alpha))


def _schedule(units: DataFrame, period: int | None) -> DataFrame:
    """``parent, unit, q, j, runs``: the slots of every unit's ``j``-th block in a period.

    ``units`` has ``parent, unit, blocks, weight``. A parent's period has about
    ``period`` blocks, four for each of its units at least; without it weights are
    blocks a period. ``runs`` has an entry for
    each run of equal periods: its first and the next one's first, the slot at its
    start, its length, the unit's blocks in it and the block's slot.
    """
    inside = Window.partitionBy("parent")
    share = F.col("weight")
    if period is not None:
        share = share / F.sum("weight").over(inside) * F.greatest(F.lit(period), 4 * F.count(F.lit(1)).over(inside))
    shares = units.withColumn("q", F.greatest(F.lit(1), F.round(share)).cast("long")).select("parent", "unit", "blocks", "q")

    # Where compositions change: the first period a unit cannot fill, and the one after.
    kinds = (
        shares.groupBy("parent")
        .agg(F.sort_array(F.collect_list(F.struct("unit", "q", "blocks"))).alias("s"))
        .select("parent", "s", F.explode(F.expr("array_distinct(concat(array(0L), flatten(transform(s, x -> array(x.blocks div x.q, x.blocks div x.q + 1L)))))")).alias("f"))
        .repartition(64, "parent", "f")  # the folds are the work
        .withColumn("c", F.expr("transform(s, x -> greatest(0L, least(x.q, x.blocks - f * x.q)))"))
        .withColumn("base", F.expr("aggregate(s, 0L, (t, x) -> t + least(x.blocks, f * x.q))"))
        .withColumn("total", F.expr("aggregate(c, 0L, (s, x) -> s + x)"))
        .where("total > 0")
        .withColumn("slots", F.expr(_EDF))
        .select("parent", "f", "base", "total", "c", "slots", F.expr("transform(s, x -> x.unit)").alias("names"), F.expr("transform(s, x -> x.q)").alias("qs"))
    )
    kinds = materialize(kinds)
    after = F.lead("f").over(Window.partitionBy("parent").orderBy("f"))
    slots = (
        kinds.withColumn("f_end", F.coalesce(after, F.lit(1 << 62)))
        .select("parent", "f", "f_end", "base", "total", "c", "names", "qs", F.posexplode("slots").alias("slot", "i"))
        .withColumn("j", F.row_number().over(Window.partitionBy("parent", "f", "i").orderBy("slot")) - 1)
        .select("parent", F.expr("names[i]").alias("unit"), F.expr("qs[i]").alias("q"), "j", F.struct("f", "f_end", "base", "total", F.expr("c[i]").alias("c"), "slot").alias("run"))
    )
    # One row for each unit and block in a period; a run of equal periods shares it.
    return slots.groupBy("parent", "unit", "q", "j").agg(F.sort_array(F.collect_list("run")).alias("runs"))


def mix(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    block: int = 4,
    alpha: float = 0.5,
    period: int = 1000,
    fan: int = 256,
) -> DataFrame:
    """Interleave the sources of ``docs`` to target weights.

    Adds ``mix_source``, ``mix_block`` (the block's number in its source),
    ``mix_slot`` (its place in the mixture, from 0 without gaps),
    ``mix_offset`` (the row's place in its block), ``mix_release`` and
    ``mix_deadline`` (of the block, as slots) and ``mix_weight`` (the source's
    share of its period). Every row is kept, repeated rows too; blocks are
    ``block`` rows, a source's last may be shorter. Null sources are one source
    of their own. ``weights`` gives blocks a period by source (1 for sources it
    leaves out); without it they are tempered sizes. Rows with equal ids and
    texts are told apart arbitrarily. An empty table stays empty. Columns of
    ``docs`` with these names, in any case, are replaced; others stay as they are.

    With more sources than ``fan`` there are levels of groups: a source is then
    within one block of its share of its group, and so on up; release and
    deadline are those of the block of its topmost group.
    """
    made = {"mix_source", "mix_block", "mix_slot", "mix_offset", "mix_release", "mix_deadline", "mix_weight"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    src, rank, none, got = (fresh(docs, x) for x in ("_src", "_rank", "_none", "_got"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    # A null source as a value, so that joins are by plain equality.
    keyed = docs.withColumn(none, F.col("source").isNull()).withColumn(src, F.coalesce(F.col("source").cast("string"), F.lit("")))
    counts = keyed.groupBy(src, none).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("long").alias("blocks"))
    weight = tempered(F.col("blocks"), alpha)
    if weights is not None:
        weight = F.lit(1.0)
        for name, q in sorted(weights.items()):
            weight = F.when((F.col(src) == name) & ~F.col(none), F.lit(float(max(1, int(q))))).otherwise(weight)
    sources = counts.select(F.struct(F.col(none).alias("none"), F.col(src).alias("name")).alias("unit"), "blocks", weight.alias("weight"))
    sources = materialize(sources)
    seen = sources.agg(F.count(F.lit(1)).alias("n"), F.max("blocks").alias("most")).first()
    n, most = seen.n, seen.most or 0

    # From the sources up: each level's units with their parents, until one parent has all.
    levels, units = [], sources
    while True:
        groups = 1 if n <= fan else -(-n * 2 // fan)
        key = F.lit(0).cast("long") if groups == 1 else F.pmod(F.xxhash64("unit", F.lit(len(levels))), F.lit(groups)).cast("long")
        named = units.withColumn("parent", key)
        levels.append(named)
        if groups == 1:
            break
        units = materialize(named.groupBy(F.col("parent").alias("unit")).agg(F.sum("blocks").alias("blocks"), F.sum("weight").alias("weight")))
        n = units.count()

    salt = [F.col(c) for c in docs.columns if c in ("doc_id", "text", "n_chars")] or [F.lit(0)]
    order = [F.col(c).asc_nulls_last() for c in docs.columns if c in ("doc_id",)] or [F.lit(0)]
    placed = distributed_rank(keyed, [src, none], order, salt, rank, salts_for(block * most))
    state = F.struct(
        F.struct(F.col(none).alias("none"), F.col(src).alias("name")).alias("source"),
        F.expr(f"`{rank}` div {block}").cast("long").alias("number"),
        F.expr(f"`{rank}` % {block}").cast("int").alias("offset"),
        F.lit(1.0).alias("weight"),
        F.lit(None).cast("long").alias("release"),
        F.lit(None).cast("long").alias("deadline"),
    )
    placed = placed.select(*names, state.alias(got))
    unit, block_at = fresh(docs, "_unit"), fresh(docs, "_at")
    placed = placed.withColumn(unit, F.col(f"{got}.source")).withColumn(block_at, F.col(f"{got}.number"))
    for number, level in enumerate(levels):
        placed = _looked_up(placed, names, level, period if weights is None or number else None, got, unit, block_at)
    g = lambda c: F.col(f"{got}.{c}")
    return placed.select(
        *names,
        F.when(~g("source.none"), g("source.name")).alias("mix_source"),
        g("number").alias("mix_block"),
        F.col(block_at).alias("mix_slot"),
        g("offset").alias("mix_offset"),
        g("release").alias("mix_release"),
        g("deadline").alias("mix_deadline"),
        g("weight").alias("mix_weight"),
    )


def _looked_up(placed: DataFrame, names: list, units: DataFrame, period: int | None, got: str, unit: str, block_at: str) -> DataFrame:
    """Blocks of units become blocks of their parents, by the parents' schedules.

    The schedule is broadcast if it is small (``MOST_BROADCAST``), else joined.
    """
    q, entry, run, at = (fresh(placed, x) for x in ("_q", "_runs", "_run", "_start"))
    unit_of, q_of, j_of, parent = (fresh(placed, x) for x in ("_unit_of", "_q_of", "_j_of", "_parent"))
    schedule = materialize(_schedule(units, period))
    schedule = schedule.select(F.col("unit").alias(unit_of), F.col("q").alias(q_of), F.col("j").cast("long").alias(j_of), F.col("parent").alias(parent), F.col("runs").alias(entry))
    small = (schedule.agg(F.sum(F.size(entry))).first()[0] or 0) <= MOST_BROADCAST
    sized = schedule.where(F.col(j_of) == 0).select(F.col(unit_of).alias(run), F.col(q_of).alias(q))
    ready = F.broadcast if small else (lambda df: df)
    joined = placed.join(ready(sized), F.col(unit) == F.col(run)).drop(run)
    joined = joined.join(ready(schedule), (F.col(unit) == F.col(unit_of)) & (F.expr(f"`{block_at}` % `{q}`") == F.col(j_of)))
    # The run that the block's period is in, and the slot at the period's start.
    joined = joined.withColumn(run, F.expr(f"filter(`{entry}`, r -> r.f <= `{block_at}` div `{q}` and `{block_at}` div `{q}` < r.f_end)[0]"))
    joined = joined.withColumn(at, F.expr(f"`{run}`.base + (`{block_at}` div `{q}` - `{run}`.f) * `{run}`.total"))
    c, total = F.col(f"{run}.c"), F.col(f"{run}.total")
    state = F.struct(
        F.col(f"{got}.source").alias("source"),
        F.col(f"{got}.number").alias("number"),
        F.col(f"{got}.offset").alias("offset"),
        (F.col(f"{got}.weight") * c / total).alias("weight"),
        (F.col(at) + F.expr(f"(`{j_of}` * `{run}`.total) div `{run}`.c")).cast("long").alias("release"),
        (F.col(at) + F.expr(f"((`{j_of}` + 1) * `{run}`.total + `{run}`.c - 1) div `{run}`.c")).cast("long").alias("deadline"),
    )
    return joined.select(*names, state.alias(got), F.col(parent).alias(unit), (F.col(at) + F.col(f"{run}.slot")).cast("long").alias(block_at))
