"""Keyed state over streams: with a clock by hand, and as running streams."""

import time
from collections import namedtuple
from datetime import datetime, timezone

import pytest
from millrace.streaming import feeds, reference
from pyspark.sql import functions as F

POINT = "topic string, symbol string, timestamp_ms long, value double, exact_value double, received_ms long, event_id long"


class Handle:
    """State and timers of one key, and a clock that a test sets."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema, ttl=None):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return sorted(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


Expired = namedtuple("Expired", "at")
Expired.getExpiryTimeInMs = lambda self: self.at


class Driven:
    def __init__(self, processor, key):
        self.p, self.key, self.h = processor, (key,), Handle()
        self.p.init(self.h)

    def rows(self, *rows):
        return [r.asDict() for r in self.p.handleInputRows(self.key, iter(rows), None)]

    def until(self, now):
        out = []
        while due := sorted(t for t in self.h.timers if t <= now):
            self.h.deleteTimer(due[0])
            out += [r.asDict() for r in self.p.handleExpiredTimer(self.key, None, Expired(due[0]))]
        return out


def test_a_feed_falls_silent_and_speaks_again():
    f = Driven(reference.FeedMonitor(100), "a")
    assert [r["stale"] for r in f.rows({"received_ms": 10}, {"received_ms": 5})] == [False]
    assert f.until(110) == []  # silent for as long, not longer
    assert f.rows({"received_ms": 60}) == [] and f.until(120) == []
    assert [(r["stale"], r["last_ms"], r["at_ms"]) for r in f.until(200)] == [(True, 60, 161)]
    assert f.until(10_000) == []
    assert f.rows({"received_ms": 60}) == []  # a repeated row is no sign of life
    assert [(r["stale"], r["messages"]) for r in f.rows({"received_ms": 900})] == [(False, 5)]
    assert len(f.h.timers) == 1


def test_polls_until_the_outcome_is_known():
    w = Driven(reference.ResolutionWatch(60, 30, 5), "m")
    w.rows({"end_ms": 100, "resolved": False}, {"end_ms": 100, "resolved": False})
    assert w.until(159) == []
    assert [(r["polls"], r["at_ms"]) for r in w.until(200)] == [(1, 160), (2, 190)]
    w.rows({"end_ms": None, "resolved": True})
    assert w.until(10_000) == [] and not w.h.timers


def test_polls_end_at_the_most():
    w = Driven(reference.ResolutionWatch(60, 30, 3), "m")
    w.rows({"end_ms": 100, "resolved": False})
    assert len(w.until(10_000)) == 3
    gone = Driven(reference.ResolutionWatch(60, 30, 3), "n")
    gone.rows({"end_ms": None, "resolved": True}, {"end_ms": 5, "resolved": False})
    assert gone.until(10_000) == []


def test_subscriptions_follow_the_market():
    s = Driven(reference.Subscription(60, 30), 7)
    s.rows({"start_ms": 1000, "end_ms": 2000})
    assert s.until(939) == []
    assert [(r["action"], r["at_ms"]) for r in s.until(940)] == [("subscribe", 940)]
    s.rows({"start_ms": 1000, "end_ms": 2500})  # a market that runs longer
    assert s.until(2530) == []
    assert [(r["action"], r["at_ms"]) for r in s.until(9999)] == [("unsubscribe", 2531)]
    assert s.h.value is None and not s.h.timers


def test_exact_beats_inexact_and_late_points_count_by_receive_time():
    b = Driven(reference.BoundaryMatch(), "a")
    b.key = ("a", "x", 10)
    row = lambda v, e, t, i: {"value": v, "exact": e, "received_ms": t, "event_id": i}
    assert [r["value"] for r in b.rows(row(1.0, False, 50, 1), row(2.0, False, 60, 2))] == [1.0]
    assert b.rows(row(1.0, False, 50, 1)) == []  # repeated
    assert [r["value"] for r in b.rows(row(3.0, False, 40, 3))] == [3.0]  # late, received before
    assert [r["value"] for r in b.rows(row(4.0, True, 90, 4))] == [4.0]
    assert b.rows(row(5.0, True, 95, 5), row(6.0, False, 1, 6)) == []


@pytest.fixture
def files(spark, tmp_path):
    """Writes rows as one file more of a folder that is read as a stream, a file a batch."""
    reference.stateful(spark)

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        time.sleep(0.02)  # files are taken by age
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")

    return put


def test_boundaries_over_batches(spark, files):
    files("points", [("a", "x", 10, 1.0, None, 50, 1), ("a", "x", 11, 9.0, 9.0, 1, 2), ("b", "x", 10, None, 7.0, 2, 3)], POINT)
    files("points", [("a", "x", 10, 3.0, None, 40, 4), ("a", "x", 10, 1.0, None, 50, 1), (None, "x", 10, 1.0, None, 1, 9)], POINT)
    stream = files("points", [("a", "y", 10, 2.0, 2.5, 70, 5), ("a", "y", 10, None, None, 1, 6), ("b", "x", 10, 8.0, None, 1, 7)], POINT)
    markets = spark.createDataFrame([(1, "a", "x", 10), (2, "a", "x", 10), (3, "a", "y", 10), (4, "b", "x", 10), (5, "c", "x", 10), (6, "a", "x", 12)], "condition_id long, topic string, symbol string, start_ms long")
    got = reference.boundary_values(feeds.sunk(reference.boundary_matches(stream, markets), "update"), markets)
    assert sorted((r["condition_id"], r["value"], r["exact"]) for r in got.collect()) == [(1, 3.0, False), (2, 3.0, False), (3, 2.5, True), (4, 7.0, True), (5, None, False), (6, None, False)]


def test_event_time_timers_fire_without_a_message(spark, files):
    schema = "feed string, received_ms long"
    files("feeds", [("a", 1_000), ("b", 2_000)], schema)
    files("feeds", [("b", 90_000)], schema)
    stream = files("feeds", [("c", 100_000)], schema)
    rows = stream.withColumn("at", F.timestamp_millis("received_ms")).withWatermark("at", "1 second")
    got = feeds.drain(reference.feed_states(rows, 20_000, "EventTime"), "update", "feed").collect()
    assert sorted((r["feed"], r["stale"]) for r in got) == [("a", True), ("b", False), ("c", False)]


def test_processing_time_timers_fire_without_new_rows(spark, files, tmp_path):
    now = int(datetime.now(timezone.utc).timestamp() * 1000)
    messages = files("live", [("a", now)], "feed string, received_ms long")
    markets = files("markets", [(1, now, False), (2, now, False), (2, None, True)], "condition_id long, end_ms long, resolved boolean")
    streams = {"stale": (reference.feed_states(messages, 1_500), "update"), "due": (reference.due_polls(markets, 500, 500), "append")}
    running = []
    for name, (df, mode) in streams.items():
        put = lambda d, epoch, n=name: d.write.mode("append").parquet(f"{tmp_path}/out-{n}")
        running.append(df.writeStream.outputMode(mode).trigger(processingTime="200 milliseconds").option("checkpointLocation", f"{tmp_path}/state-{name}").foreachBatch(put).start())
    try:
        end = time.time() + 60
        stale, due = set(), set()
        while time.time() < end and not (("a", True) in stale and {(1, 1), (1, 2)} <= due):
            time.sleep(1)
            if all((tmp_path / f"out-{n}" / "_SUCCESS").exists() for n in streams):
                stale = {(r["feed"], r["stale"]) for r in spark.read.schema(reference.FEED).parquet(f"{tmp_path}/out-stale").collect()}
                due = {(r["condition_id"], r["polls"]) for r in spark.read.schema(reference.DUE).parquet(f"{tmp_path}/out-due").collect()}
    finally:
        for q in running:
            q.stop()
    assert ("a", True) in stale and {(1, 1), (1, 2)} <= due and not any(c == 2 for c, _ in due)


def test_a_watch_calls_its_store_only_for_what_changes():
    from millrace.streaming.reference import ResolutionWatch

    calls, held = [], {}

    class Store:
        def exists(self):
            calls.append("exists")
            return "v" in held

        def get(self):
            calls.append("get")
            return held.get("v")

        def update(self, v):
            calls.append("update")
            held["v"] = v

        def listTimers(self):
            calls.append("list")
            return iter([7])

        def deleteTimer(self, at):
            calls.append("delete")

        def registerTimer(self, at):
            calls.append(f"at {at}")

    w = ResolutionWatch(10, 10, 1)
    w.handle = w.state = Store()

    def run(end, resolved):
        calls.clear()
        assert list(w.handleInputRows((1,), iter([{"end_ms": end, "resolved": resolved}]), None)) == []
        return list(calls)

    assert run(100, False) == ["get", "update", "at 110"]
    assert run(None, False) == ["get"]
    assert run(200, False) == ["get", "update", "list", "delete", "at 210"]
    assert run(None, True) == ["get", "update", "list", "delete"]
    assert run(None, True) == ["get"]
