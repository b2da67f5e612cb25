"""The stateful operators over files that arrive in order."""

import datetime as dt
import random

import numpy as np
import pytest

from tidewright.operators.state import breaker_states, cached, single_flight
from tidewright.streaming import events as E


def run(spark, stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def write(spark, rows, schema, folder):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{folder}/{i}")


def read(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(folder))


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, E.ROCKSDB)
    yield
    spark.conf.set(name, was)


def test_breaker_stream_matches_batch(spark, tmp_path):
    schema = "target string, seq bigint, ts_ms bigint, failed boolean"
    calls = [("t", i, i * 1000, i % 7 != 5) for i in range(20)]
    write(spark, [calls[:8], calls[8:]], schema, tmp_path)
    got = sorted((r.seq, r.failures, r.open_until) for r in run(spark, E.breaker_stream(read(spark, schema, tmp_path)), "breaker"))
    want = breaker_states(spark.createDataFrame(calls, schema)).orderBy("seq").collect()
    assert got == [(r.seq, r.failures, r.open_until) for r in want]


def test_failures_in_a_row():
    rng = random.Random(1)
    for n in (1, 2, 9, 40):
        failed, before = [rng.random() < 0.7 for _ in range(n)], rng.randrange(4)
        want, run_ = [], before
        for f in failed:
            run_ = run_ + 1 if f else 0
            want.append(run_)
        assert E.failures_in_a_row(np.array(failed), before).tolist() == want


def test_debounced_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "k string, ts timestamp"
    write(spark, [[("a", at(0)), ("a", at(1)), ("a", at(5))], [("a", at(60))], [("a", at(120))]], schema, tmp_path)
    got = run(spark, E.debounced_stream(read(spark, schema, tmp_path), "k", "ts"), "debounced")
    assert {(r.first.second, r.n) for r in got} >= {(0, 2), (5, 1)}


CALLS = "key string, call bigint, start timestamp, took_ms bigint, ok boolean"
T0 = dt.datetime(2024, 1, 1)


def some_calls(seed, n=120, keys=3):
    """Calls that arrive out of order, by a few seconds at most; lifetimes of none to many calls."""
    rng, at, rows = random.Random(seed), 0, []
    for call in range(n):
        at += rng.choice([0, 0, 250, 1000, 4000])
        rows.append((f"k{rng.randrange(keys)}", call, T0 + dt.timedelta(milliseconds=at), rng.choice([None, 0, 500, 3000, 20_000]), rng.random() < 0.6))
    late = [(r[2] + dt.timedelta(seconds=rng.random() * 9), r) for r in rows]
    return [r for _, r in sorted(late, key=lambda x: x[0])]


@pytest.mark.parametrize(("stream", "batch", "name"), [(E.cached_stream, cached, "cached"), (E.single_flight_stream, single_flight, "flights")])
def test_leaders_over_batches_are_those_of_the_whole(spark, tmp_path, rocksdb, stream, batch, name):
    """Results expire between batches and inside them; calls arrive out of order."""
    calls = some_calls(7)
    end = [("end", 10_000, T0 + dt.timedelta(days=1), 1, True)]
    write(spark, [calls[:30], calls[30:37], calls[37:90], calls[90:], end], CALLS, tmp_path)
    got = {r.call: r for r in run(spark, stream(read(spark, CALLS, tmp_path), late="10 seconds"), name)}
    ms = [(k, c, int((s - T0).total_seconds() * 1000), t, ok) for k, c, s, t, ok in calls]
    want = batch(spark.createDataFrame(ms, "key string, call bigint, start bigint, took bigint, ok boolean")).collect()
    assert set(got) == {r.call for r in want}
    for r in want:
        assert got[r.call].leader == r.leader and (name == "flights" or got[r.call].hit == r.hit)


def test_a_call_after_the_end_leads_anew(spark, tmp_path, rocksdb):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    calls = [("a", 1, at(0), 5000, True), ("a", 2, at(4.9), 5000, True), ("a", 3, at(5), 5000, False), ("a", 4, at(5.5), 5000, True), ("a", 5, at(6), 5000, True)]
    write(spark, [calls[:1], calls[1:3], calls[3:], [("b", 9, at(100), 1, True)]], CALLS, tmp_path)
    got = {r.call: (r.leader, r.hit) for r in run(spark, E.cached_stream(read(spark, CALLS, tmp_path), late="1 second"), "anew")}
    assert got == {1: (1, False), 2: (1, True), 3: (3, False), 4: (4, False), 5: (4, True)}
