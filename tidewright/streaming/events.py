"""The stateful operators over streams.

Caches and single flights keep state by key with event-time timers: calls wait until the
watermark has passed their start, so that they are taken in the order of their starts
however they arrive, and give what the batch forms give. They need the RocksDB
state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BREAKER_SCHEMA = "target string, seq bigint, ts_ms bigint, failures int, open_until bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def debounced_stream(events: DataFrame, key: str, ts: str, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """A row for each run of events less than ``gap`` apart, once the watermark has passed it."""
    return (
        events.withWatermark(ts, late)
        .groupBy(key, F.session_window(ts, gap).alias("w"))
        .agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))
        .drop("w")
    )


def failures_in_a_row(failed: np.ndarray, before: int) -> np.ndarray:
    """Of each call the failures in a row that end with it; ``before`` are those before the first."""
    at = np.arange(len(failed))
    fine = np.maximum.accumulate(np.where(failed, -1, at))
    return np.where(failed, at - fine + np.where(fine < 0, before, 0), 0)


def breaker_stream(calls: DataFrame, threshold: int = 3, cool_ms: int = 30_000) -> DataFrame:
    """The state of each target's breaker after each call, kept between batches.

    ``calls`` has ``target, seq, ts_ms, failed``; a batch's calls of a target are
    taken in the order of ``ts_ms, seq``.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts_ms", "seq"])
        failures = failures_in_a_row(rows["failed"].to_numpy(bool), state.get[0] if state.exists else 0)
        state.update((int(failures[-1]),))
        until = np.where(failures >= threshold, rows["ts_ms"].to_numpy() + cool_ms, 0)
        yield pd.DataFrame({"target": key[0], "seq": rows["seq"].to_numpy(), "ts_ms": rows["ts_ms"].to_numpy(), "failures": failures, "open_until": until})

    return calls.groupBy("target").applyInPandasWithState(run, BREAKER_SCHEMA, "failures int", "append", GroupStateTimeout.NoTimeout)


def leaders(starts: np.ndarray, ends: np.ndarray, waits: np.ndarray, until: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Of calls in order the index of each one's leader (-1: the one that ends at ``until``), and which ones lead.

    From a leader the search goes to the first call that starts at or after its end, so
    there is a step a leader and none a call that shares its result.
    """
    out = np.full(len(starts), -1)
    at = 0 if until is None else int(np.searchsorted(starts, until))
    while at < len(starts):
        then = max(at + 1, int(np.searchsorted(starts, ends[at]))) if waits[at] else at + 1
        out[at:then] = at
        at = then
    return out, out == np.arange(len(starts))


class _Leaders(StatefulProcessor):
    """A key's waiting calls, and the call whose result is shared until a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "call bigint, start_us bigint, took_us bigint, stored boolean")
        self.lead = handle.getValueState("lead", "call bigint, until_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            took = [None if pd.isna(t) else int(t) for t in frame["took_us"]]
            new = list(zip(map(int, frame["call"]), map(int, frame["start_us"]), took, map(bool, frame["stored"]), strict=True))
            self.waiting.appendList(new)
            least = min(c[1] for c in new)
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(max(0, first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        calls = sorted(map(tuple, self.waiting.get()), key=lambda c: (c[1], c[0]))
        due, later = [c for c in calls if c[1] <= now], [c for c in calls if c[1] > now]
        lead = self.lead.get() if self.lead.exists() else None
        if due:
            starts = np.array([c[1] for c in due], np.int64)
            waits = np.array([c[3] and c[2] is not None and c[2] > 0 for c in due])
            ends = starts + np.array([c[2] or 0 for c in due], np.int64)
            of, own = leaders(starts, ends, waits, lead[1] if lead else None)
            ids = np.array([c[0] for c in due], np.int64)
            leader = np.where(of < 0, lead[0] if lead else -1, ids[np.maximum(of, 0)])
            last = np.flatnonzero(own)[-1:]
            if len(last):
                lead = (int(ids[last[0]]), int(ends[last[0]])) if waits[last[0]] else None
            yield pd.DataFrame({"key": key[0], "call": ids, "start_us": starts, "leader": leader, "hit": ~own})
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][1] // 1000)
        else:
            self.waiting.clear()
        if lead is None or lead[1] <= now:
            self.lead.clear()
        else:
            self.lead.update(lead)
            self.handle.registerTimer(-(-lead[1] // 1000))

    def close(self) -> None:
        pass


def _led_stream(calls: DataFrame, stored: Column, late: str) -> DataFrame:
    micros = lambda c: F.unix_micros(c)
    took = (F.col("took_ms") * 1000).cast("bigint").alias("took_us")
    rows = calls.withWatermark("start", late).select("key", "call", "start", micros(F.col("start")).alias("start_us"), took, F.coalesce(stored, F.lit(False)).alias("stored"))
    made = rows.groupBy("key").transformWithStateInPandas(_Leaders(), "key string, call bigint, start_us bigint, leader bigint, hit boolean", "append", "eventTime")
    return made.select("key", "call", F.timestamp_micros("start_us").alias("start"), "leader", "hit")


def cached_stream(calls: DataFrame, late: str = "30 seconds") -> DataFrame:
    """Of each call the ``leader`` whose result it has, and whether that is a ``hit``: :func:`state.cached` over a stream.

    ``calls`` has ``key`` (string), ``call`` (bigint), ``start`` (timestamp), ``took_ms`` (how long a result lives) and
    ``ok``; only good results are stored. A row comes when the watermark, ``late`` behind
    the latest start, has passed the call's start. A key's state goes when its result has expired.
    """
    return _led_stream(calls, F.col("ok"), late)


def single_flight_stream(calls: DataFrame, late: str = "30 seconds") -> DataFrame:
    """Of each call the ``leader`` that was under way when it came: :func:`state.single_flight` over a stream.

    ``calls`` is as for :func:`cached_stream`, without ``ok``: followers share errors
    too. A leader without a time (``took_ms`` null or not positive) ends without a result: it leaves nothing, the next call leads.
    """
    return _led_stream(calls, F.lit(True), late).drop("hit")
