"""Version state, authorization, routing, breakers, caches and summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.predicates import is_target_fault
from tidewright.functions.text import effective_version, first_non_blank, is_primary
from tidewright.operators.ranges import carried, earlier, later, ranged, upto
from tidewright.sources.shared import materialize

_VERSION = ("appVersion", "appHash", "dataVersion", "assetVersion", "assetHash", "cdnVersion")


def merge_versions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge version rows by ``region``.

    App fields: the existing value unless blank. Data and asset fields: the
    incoming one unless blank; secondary regions take a blank asset hash. The
    content version is the incoming one if positive, else the existing, else 0.
    Regions on one side only are kept; other columns of ``existing`` stay.
    """
    old = existing.select("region", *[F.col(c).alias(f"o_{c}") for c in _VERSION], *[c for c in existing.columns if c not in (*_VERSION, "region")])
    new = incoming.select(F.col("region").alias("n_region"), *[F.col(c).alias(f"n_{c}") for c in _VERSION])
    both = old.join(new, F.col("region") == F.col("n_region"), "full").withColumn("region", F.coalesce("region", "n_region"))
    region, o, n = F.col("region"), (lambda c: F.col(f"o_{c}")), (lambda c: F.col(f"n_{c}"))
    answered = F.col("n_region").isNotNull()
    positive = lambda c: F.when(c > 0, c)
    merged = {
        "appVersion": effective_version(region, first_non_blank(o("appVersion"), n("appVersion"))),
        "appHash": first_non_blank(o("appHash"), n("appHash")),
        "dataVersion": first_non_blank(n("dataVersion"), o("dataVersion")),
        "assetVersion": first_non_blank(n("assetVersion"), o("assetVersion")),
        "assetHash": F.when(is_primary(region) | ~answered, first_non_blank(n("assetHash"), o("assetHash"))).otherwise(
            F.coalesce(n("assetHash"), F.lit(""))
        ),
        "cdnVersion": F.coalesce(positive(n("cdnVersion")), positive(o("cdnVersion")), F.lit(0)),
    }
    rest = [c for c in existing.columns if c not in (*_VERSION, "region")]
    return both.select("region", *[v.alias(k) for k, v in merged.items()], *rest)


def app_hash_changes(current: DataFrame, answers: DataFrame) -> DataFrame:
    """The first source that answers decides: ``region, appVersion, appHash, changed``.

    ``answers`` has ``region, seq, appVersion, appHash`` (both null: no answer).
    Blank fields are inherited from ``current``.
    """
    said = answers.where("appVersion is not null or appHash is not null")
    first = said.groupBy("region").agg(F.min_by(F.struct("appVersion", "appHash"), "seq").alias("a"))
    both = current.select("region", F.col("appVersion").alias("v"), F.col("appHash").alias("h")).join(first, "region")
    version = effective_version(F.col("region"), first_non_blank(F.col("a.appVersion"), F.col("v")))
    hash_ = first_non_blank(F.col("a.appHash"), F.col("h"))
    return both.select("region", version.alias("appVersion"), hash_.alias("appHash")).join(
        current.select(F.col("region").alias("r"), F.col("appVersion").alias("v"), F.col("appHash").alias("h")), F.col("region") == F.col("r")
    ).select("region", "appVersion", "appHash", ((F.col("appVersion") != F.col("v")) | (F.col("appHash") != F.col("h"))).alias("changed"))


def preferred_versions(bundled: DataFrame, polled: DataFrame) -> DataFrame:
    """The version row of each ``region``: the bundle's, as a whole, where there is one, else the polled one."""
    b = bundled.select("region", F.struct(*_VERSION).alias("b"))
    p = polled.select(F.col("region").alias("_r"), F.struct(*_VERSION).alias("p"))
    both = b.join(p, F.col("region") == F.col("_r"), "full")
    return both.select(F.coalesce("region", "_r").alias("region"), F.coalesce("b", "p").alias("v")).select("region", "v.*")


def regions_to_ingest(versions: DataFrame, last_runs: DataFrame) -> DataFrame:
    """``region, due, retry``: due by a new version, or because the last ingest failed (``retry``).

    ``versions`` has ``region, is_new``; ``last_runs`` has ``region, failed`` (no row: none failed).
    """
    runs = last_runs.groupBy(F.col("region").alias("_r")).agg(F.max("failed").alias("failed"))
    both = versions.join(runs, F.col("region") == F.col("_r"), "left")
    failed = F.coalesce("failed", F.lit(False))
    return both.select("region", (F.col("is_new") | failed).alias("due"), (~F.col("is_new") & failed).alias("retry"))


def authorize(
    requests: DataFrame, users: DataFrame, grants: DataFrame, open_mode: bool = False, user_fault: Column | None = None, grant_fault: Column | None = None
) -> DataFrame:
    """Add ``status``: 200, 401 (no such user or another credential), 403 (no grant) or 500.

    ``user_fault`` and ``grant_fault`` say of a request that the look-up failed; a
    grant is only looked up for a known user. A user id has one credential, the
    smallest if ``users`` repeats it; requests stay as many as they are.
    """
    if open_mode:
        return requests.withColumn("status", F.lit(200))
    u = users.groupBy(F.col("id").alias("_u")).agg(F.min("credential").alias("_c"))
    g = grants.select(F.col("user_id").alias("_g"), F.col("server").alias("_s")).distinct()
    joined = requests.join(u, F.col("user_id") == F.col("_u"), "left").join(
        g, (F.col("user_id") == F.col("_g")) & (F.col("server") == F.col("_s")), "left"
    )
    fails = lambda c: F.lit(False) if c is None else F.coalesce(c, F.lit(False))
    status = (
        F.when(fails(user_fault), 500)
        .when(F.col("_u").isNull() | ~F.col("credential").eqNullSafe(F.col("_c")), 401)
        .when(fails(grant_fault), 500)
        .when(F.col("_g").isNull(), 403)
        .otherwise(200)
    )
    return joined.withColumn("status", status).drop("_u", "_c", "_g", "_s")


def summarize(rows: DataFrame, key: str, value: str, parts: tuple[int, ...] = (50, 95)) -> DataFrame:
    """``n, min, p50, mean, p95, max`` by key; percentiles are values, by the nearest rank.

    The rank is ``p / 100 * (n - 1)``, halves up. Equal values are one row with a
    count; those are cut into ranges of values, so a key's ranks come from many
    tasks and no list is built. Nulls are left out; a key without values has zeros.
    """
    plain = rows.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"))
    counted = materialize(plain.groupBy("_key", "_v").agg(F.count("_v").alias("_k")))  # nulls: one row that counts nothing
    cut = ranged(counted, ["_v"])

    def carry(known: DataFrame) -> DataFrame:
        before = F.coalesce(F.sum("_c").over(earlier(["_key"])), F.lit(0))
        return known.withColumn("_before", before).withColumn("_n", F.sum("_c").over(Window.partitionBy("_key")))

    known = carried(cut, ["_key"], {"_c": F.sum("_k")}, carry, ["_before", "_n"])
    ranked = known.withColumn("_upto", F.col("_before") + F.sum("_k").over(upto(["_key"], ["_v"])))
    at = lambda p: F.min(F.when(F.col("_upto") > F.floor(F.lit(p) / 100 * (F.col("_n") - 1) + 0.5), F.col("_v")))
    found = ranked.groupBy("_key").agg(
        F.max("_n").alias("n"),
        F.min("_v").alias("min"),
        *[at(p).alias(f"p{p}") for p in parts],
        F.try_divide(F.sum(F.col("_v") * F.col("_k")), F.sum("_k")).alias("mean"),
        F.max("_v").alias("max"),
    )
    measures = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("min", *[f"p{p}" for p in parts], "mean", "max")]
    return found.select(F.col("_key").alias(key), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), *measures)


def composed(rows: DataFrame, totals: dict[str, list[str]]) -> DataFrame:
    """Add for each total, such as an old and a new way of doing the same, the sum of its stages."""
    for name, stages in totals.items():
        total = F.lit(0.0)
        for s in stages:
            total = total + F.coalesce(F.col(s).cast("double"), F.lit(0.0))
        rows = rows.withColumn(name, total)
    return rows


def after_warm_up(rows: DataFrame, key: str, order: str, first: int) -> DataFrame:
    """``rows`` without the ``first`` ones of each key by ``order`` (unique in a key).

    The warm-up rows are found by a top-k window, of which each task keeps a few
    rows before the shuffle, and left out by an anti-join (broadcast if Spark finds them small).
    """
    warm = rows.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("_r"))
    warm = warm.where(F.col("_r") <= first)
    return rows.join(warm, F.col(key).eqNullSafe(F.col("_k")) & (F.col(order) == F.col("_o")), "left_anti")


def routed_order(targets: DataFrame) -> DataFrame:
    """Add ``place``: closed breakers first, then by priority, local ones first on ties, then as listed.

    ``targets`` has ``request, seq, priority, is_local, is_open``.
    """
    w = Window.partitionBy("request").orderBy("is_open", "priority", F.col("is_local").desc(), "seq")
    return targets.withColumn("place", F.row_number().over(w))


def first_outcome(attempts: DataFrame) -> DataFrame:
    """Of each request the first success or error that is not the target's fault; else the last fault.

    ``attempts`` has ``request, place, error`` (null: success). Without attempts
    a request has no row.
    """
    stops = F.col("error").isNull() | ~is_target_fault(F.col("error"))
    picked = F.min_by(F.struct("place", "error"), F.when(stops, F.col("place")))
    last = F.max_by(F.struct("place", "error"), "place")
    out = attempts.groupBy("request").agg(F.when(F.max(stops), picked).otherwise(last).alias("o"))
    return out.select("request", "o.place", "o.error")


def round_robin(slots: DataFrame) -> DataFrame:
    """Of each request the first idle slot from the cursor on, around; the cursor's if all are busy.

    ``slots`` has ``request, idx, busy, cursor, n``. Slots of which it is not known
    whether they are busy (null) come last.
    """
    away = F.pmod(F.col("idx") - F.col("cursor"), F.col("n"))
    order = F.struct(F.col("busy").isNull().alias("unknown"), "busy", away.alias("away"))
    return slots.groupBy("request").agg(F.min_by("idx", order).alias("idx"))


def first_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``key, value``: of each key the value that comes first in ``order``."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def member_order(number: Column, text: Column, name: Column) -> Column:
    """What generated fields are sorted by: whole-number keys first, then text keys, or else names, by bytes."""
    return F.struct(F.coalesce(number.cast("int"), F.lit(2147483647)).alias("number"), F.coalesce(text, name).alias("text"))


def breaker_states(calls: DataFrame, threshold: int = 3, cool_ms: int = 30_000) -> DataFrame:
    """Add ``failures`` (in a row, with this one) and ``open_until`` (ms; 0: closed) after each call.

    ``calls`` has ``target, ts_ms, seq, failed``. Inside a range of time, successes
    cut a target's calls into islands and failures are counted in them; those
    before a range's first success go on from the ranges before.
    """
    by, order = ["target"], ["ts_ms", "seq"]
    cut = ranged(calls, order)
    marked = cut.withColumn("_i", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(upto(by, order)))
    marked = marked.withColumn("_run", F.sum(F.col("failed").cast("int")).over(upto([*by, "_i"], order)))

    def carry(known: DataFrame) -> DataFrame:
        sums = known.withColumn("_sum", F.coalesce(F.sum("_tail").over(earlier(by)), F.lit(0)))
        since = F.coalesce(F.last(F.when(F.col("_ok"), F.col("_sum")), ignorenulls=True).over(earlier(by)), F.lit(0))
        return sums.withColumn("_carry", F.col("_sum") - since)

    facts = {"_ok": F.max(~F.col("failed")), "_tail": F.max_by("_run", F.struct(*order))}
    known = carried(marked, by, facts, carry, ["_carry"])
    failures = F.col("_run") + F.when(F.col("_i") == 0, F.col("_carry")).otherwise(0)
    known = known.withColumn("failures", F.when(F.col("failed"), failures).otherwise(0))
    open_until = F.when(F.col("failures") >= threshold, F.col("ts_ms") + cool_ms).otherwise(0)
    return known.withColumn("open_until", open_until.cast("bigint")).drop("_i", "_run", "_carry", "_range")


def debounced(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """One row for each run of events less than ``gap`` apart: ``key, first, last, n``.

    A run starts where the event before, in the range or the key's last one before
    it, is ``gap`` or more away; runs are numbered over ranges by their counts.
    """
    by = [key]
    cut = ranged(events.select(key, ts).where(F.col(ts).isNotNull()), [ts])
    known = carried(cut, by, {"_max": F.max(ts)}, lambda k: k.withColumn("_prev", F.max("_max").over(earlier(by))), ["_prev"])
    before = F.coalesce(F.lag(ts).over(Window.partitionBy(key, "_range").orderBy(ts)), F.col("_prev"))
    starts = F.when(F.col(ts) < before + F.expr(f"INTERVAL '{gap}'"), 0).otherwise(1)
    marked = known.withColumn("_start", starts).withColumn("_run", F.sum("_start").over(upto(by, [ts])))
    so_far = lambda k: k.withColumn("_before", F.coalesce(F.sum("_starts").over(earlier(by)), F.lit(0)))
    numbered = carried(marked, by, {"_starts": F.sum("_start")}, so_far, ["_before"])
    return (
        numbered.groupBy(key, (F.col("_run") + F.col("_before")).alias("_run"))
        .agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))
        .drop("_run")
    )


def single_flight(calls: DataFrame) -> DataFrame:
    """Add ``leader``: the call whose result this one shares.

    ``calls`` has ``key, call, start, took``. A call that starts while its key's
    leader is under way follows it; the first after it ended leads.
    """
    return _led(calls, F.lit(True))


def cached(calls: DataFrame) -> DataFrame:
    """Add ``leader`` and ``hit``: calls in the time-to-live of a stored result have it.

    ``calls`` has ``key, call, start, took`` (the time a result lives) and
    ``ok``; only good results are stored.
    """
    return _led(calls, F.col("ok")).withColumn("hit", F.col("leader") != F.col("call"))


def _inner(rows: pd.DataFrame) -> np.ndarray:
    """Of the calls of a range the place of the one that each goes on to in the range; the place after all for none."""
    ids = rows["id"].to_numpy()
    order = np.argsort(ids)
    inside = (rows["to_range"] == rows["range"]).to_numpy()
    to = order[np.minimum(np.searchsorted(ids, rows["to"].to_numpy(), sorter=order), len(ids) - 1)]
    return np.append(np.where(inside, to, len(ids)), len(ids))


def _ways_out(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each call of a range the call in another one that its chain comes to; none where the chain ends before."""
    to, n = _inner(rows), len(rows)
    last = np.where(to == n, np.arange(n + 1), to)  # the end of a chain stays there
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    out = rows["to"].to_numpy()[last[:n]]
    return pd.DataFrame({"id": rows["id"].to_numpy()[out >= 0], "to": out[out >= 0]})


def _led_from(rows: pd.DataFrame) -> pd.DataFrame:
    """The calls of a range that lead: those it is entered at, and those that chains go on to from there."""
    to, on = _inner(rows), np.append(rows["led"].to_numpy(bool), False)
    while True:
        more = on.copy()
        more[to[on]] = True
        more[-1] = False
        to = to[to]
        if (more == on).all() and (to == len(rows)).all():
            break
        on = more
    return pd.DataFrame({"lead": rows["id"].to_numpy()[on[:-1]]})


def _led(calls: DataFrame, stored: Column) -> DataFrame:
    """Add each call's ``leader``.

    If a call leads, it is known which one leads next: the first that starts at or
    after its end, or its successor if nothing was stored. So leaders are a chain
    from a key's first call. The next ones are found inside ranges of time; a chain is
    followed inside a range, which is of bounded size, at once, and from range to range by
    pointer doubling over joins. No list of a key's calls is built.
    """
    rows = materialize(calls.withColumn("_id", F.monotonically_increasing_id()).withColumn("_stored", F.coalesce(stored, F.lit(False))))
    by, order = ["key"], ["at", "late", "call", "id", "asks"]
    start, ends = F.col("start"), F.col("start") + F.col("took")
    waits = F.coalesce(F.col("_stored") & (F.col("took") > 0), F.lit(False))  # a call without a time leaves nothing

    def event(at: Column, late: Column, call: Column, asks: int) -> Column:
        return F.struct(at.alias("at"), late.alias("late"), call.alias("call"), F.col("_id").alias("id"), F.lit(asks).alias("asks"))

    asked = event(F.when(waits, ends).otherwise(start), F.when(waits, 0).otherwise(1), F.when(~waits, F.col("call")), 1)
    events = rows.select("key", F.explode(F.array(event(start, F.lit(1), F.col("call"), 0), asked)).alias("e")).select("key", "e.*")
    cut = ranged(events, order)
    is_call = F.col("asks") == 0

    # The first call after each question, in its range or the next one that has any.
    back = Window.partitionBy(*by, "_range").orderBy(*[F.desc_nulls_last(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    call = F.when(is_call, F.struct("id", "_range"))
    first = F.min_by(call, F.when(is_call, F.struct(*order)))
    known = carried(cut, by, {"_first": first}, lambda k: k.withColumn("_next", F.last("_first", ignorenulls=True).over(later(by))), ["_next"])
    found = F.coalesce(F.last(call, ignorenulls=True).over(back), F.col("_next"))
    asked_of = known.withColumn("to", found).where("asks = 1 and to is not null").select("id", F.col("to.id").alias("to"), F.col("to._range").alias("to_range"))
    calls_at = cut.where(is_call).select(F.col("id").alias("_c"), F.col("_range").alias("range"))
    hops = materialize(calls_at.join(asked_of, F.col("_c") == F.col("id"), "left").select(F.col("_c").alias("id"), "range", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("to", "to_range")]))

    # Inside a range chains are followed at once; only the way from where a chain comes into a range to where it leaves it is doubled.
    ways = materialize(hops.groupBy("range").applyInPandas(_ways_out, "id bigint, to bigint"))
    lead = materialize(cut.where(is_call).groupBy("key").agg(F.min_by("id", F.struct(*order)).alias("lead")).select("lead"))
    enters = lead.unionByName(ways.select(F.col("to").alias("lead"))).distinct()
    far = materialize(ways.join(enters, F.col("id") == F.col("lead"), "left_semi"))
    while not far.isEmpty():
        new = materialize(lead.join(far, F.col("lead") == F.col("id")).select(F.col("to").alias("lead")))
        if new.isEmpty():
            break
        lead = lead.unionByName(new)
        further = far.select(F.col("id").alias("to_id"), F.col("to").alias("to_to"))
        far = materialize(far.join(further, F.col("to") == F.col("to_id")).select("id", F.col("to_to").alias("to")))
    entered = hops.join(lead, F.col("id") == F.col("lead"), "left").select("id", "range", "to", "to_range", F.col("lead").isNotNull().alias("led"))
    lead = entered.groupBy("range").applyInPandas(_led_from, "lead bigint")

    led = cut.where(is_call).join(lead, F.col("id") == F.col("lead"), "left").withColumn("_l", F.when(F.col("lead").isNotNull(), F.struct("call")))
    last = F.max_by("_l", F.when(F.col("_l").isNotNull(), F.struct(*order)))
    known = carried(led, by, {"_last": last}, lambda k: k.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier(by))), ["_before"])
    leader = F.coalesce(F.last("_l", ignorenulls=True).over(upto(by, order)), F.col("_before"))
    done = known.select(F.col("id").alias("_of"), leader["call"].alias("leader"))
    return rows.join(done, F.col("_id") == F.col("_of")).drop("_id", "_of", "_stored")
