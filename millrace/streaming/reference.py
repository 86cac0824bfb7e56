"""Keyed state over streams: reference values at market boundaries, silent feeds, overdue resolutions, subscriptions.

Each is a `transformWithState` processor. With time_mode "ProcessingTime" timers follow the clock, and fire in batches
without new rows; with "EventTime" they follow the watermark, so a replay of stored rows gives the rows that the
live stream gave. State is kept by key and spread over tasks; time to live and deleted timers bound it. The
state provider must be RocksDB (`stateful` sets it).

Defined results: rows with a null key or time are left out; repeated rows change nothing; of late rows the times decide,
not the order of arrival; a stream without rows gives none.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Workers need not have this package: its processors travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BOUNDARY = ["topic", "symbol", "start_ms"]
MATCH = "topic string, symbol string, start_ms long, value double, exact boolean, received_ms long, event_id long"
FEED = "feed string, last_ms long, messages long, stale boolean, at_ms long"
DUE = "condition_id long, end_ms long, polls long, at_ms long"
ACTION = "token long, action string, at_ms long"


def stateful(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB provider."""
    spark.conf.set(PROVIDER, ROCKS)


class Keyed(StatefulProcessor):
    """One value state with named columns, as a dict."""

    fields = ""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fields, self.ttl_ms)

    def held(self) -> dict[str, Any] | None:
        values = self.state.get()  # one call to the store: None where there is no state
        return None if values is None else dict(zip([f.split()[0] for f in self.fields.split(", ")], values, strict=True))

    def keep(self, **values) -> None:
        self.state.update(tuple(values[f.split()[0]] for f in self.fields.split(", ")))

    def rearm(self, at_ms: int | None) -> None:
        """One timer a key."""
        for old in [t if isinstance(t, int) else t[0] for t in self.handle.listTimers()]:
            self.handle.deleteTimer(old)
        if at_ms is not None:
            self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass


class BoundaryMatch(Keyed):
    """The value at a boundary: an exact one beats an inexact one, of equal ones the first received stays."""

    fields = "value double, exact boolean, received_ms long, event_id long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.held()
        rank = lambda r: (not r["exact"], r["received_ms"], r["event_id"])
        best = held
        for r in rows:
            r = {f: r[f] for f in ("value", "exact", "received_ms", "event_id")}
            if best is None or rank(r) < rank(best):
                best = r
        if best is not held:
            self.keep(**best)
            yield Row(topic=key[0], symbol=key[1], start_ms=key[2], **best)


def boundary_matches(points: DataFrame, boundaries: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A row for each boundary whenever its value changes. points: a stream (topic, symbol, timestamp_ms, value,
    exact_value, received_ms, event_id), exact_value null where the feed gave none; boundaries: a static table of
    (topic, symbol, start_ms). Points of no boundary take no state."""
    at = points.where("value IS NOT NULL OR exact_value IS NOT NULL").select("topic", "symbol", F.col("timestamp_ms").alias("start_ms"), F.coalesce("exact_value", "value").alias("value"), F.col("exact_value").isNotNull().alias("exact"), "received_ms", "event_id")
    met = at.join(boundaries.select(*BOUNDARY).distinct(), BOUNDARY, "left_semi")
    return met.groupBy(*BOUNDARY).transformWithState(BoundaryMatch(ttl_ms), MATCH, "Update", "ProcessingTime" if ttl_ms else "None")


def boundary_values(matches: DataFrame, markets: DataFrame) -> DataFrame:
    """(condition_id, topic, symbol, start_ms, value, exact) of every market, from the matches that a sink holds: the best of each
    boundary; NULL and not exact where none matched."""
    best = matches.groupBy(*BOUNDARY).agg(F.min_by(F.struct("value", "exact"), F.struct(~F.col("exact"), "received_ms", "event_id")).alias("r"))
    return markets.join(best, BOUNDARY, "left").select("condition_id", *BOUNDARY, "r.value", F.coalesce("r.exact", F.lit(False)).alias("exact"))


class FeedMonitor(Keyed):
    """Says when a feed falls silent for longer than `after`, and when it speaks again."""

    fields = "last_ms long, messages long, stale boolean"

    def __init__(self, after_ms: int):
        super().__init__()
        self.after_ms = after_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.held() or {"last_ms": -(1 << 62), "messages": 0, "stale": None}
        times = [r["received_ms"] for r in rows]
        last = max(held["last_ms"], *times)
        fresh = last > held["last_ms"]
        was, stale = held["stale"], held["stale"] if held["stale"] and not fresh else False
        self.keep(last_ms=last, messages=held["messages"] + len(times), stale=stale)
        if fresh:
            self.rearm(last + self.after_ms + 1)  # silent for longer, not as long
        if stale != was:
            yield Row(feed=key[0], last_ms=last, messages=held["messages"] + len(times), stale=stale, at_ms=last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if held and not held["stale"] and held["last_ms"] + self.after_ms < due:
            self.keep(**held | {"stale": True})
            yield Row(feed=key[0], last_ms=held["last_ms"], messages=held["messages"], stale=True, at_ms=due)


def feed_states(messages: DataFrame, after_ms: int, time_mode: str = "ProcessingTime") -> DataFrame:
    """Changes of each feed between live and stale. messages: a stream of (feed, received_ms)."""
    rows = messages.where("feed IS NOT NULL AND received_ms IS NOT NULL")
    return rows.groupBy("feed").transformWithState(FeedMonitor(after_ms), FEED, "Update", time_mode)


class ResolutionWatch(Keyed):
    """Asks for a market's outcome `wait` after its end, and again every `again`, until it is known."""

    fields = "end_ms long, resolved boolean, polls long"

    def __init__(self, wait_ms: int, again_ms: int, most: int):
        super().__init__()
        self.wait_ms, self.again_ms, self.most = wait_ms, again_ms, most

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        was = self.held()
        held = dict(was or {"end_ms": None, "resolved": False, "polls": 0})
        had = held["end_ms"]
        for r in rows:
            if r["end_ms"] is not None and (held["end_ms"] is None or r["end_ms"] > held["end_ms"]):
                held["end_ms"] = r["end_ms"]
            held["resolved"] = held["resolved"] or bool(r["resolved"])
        if held == was:
            return iter(())
        self.keep(**held)
        armed = had is not None and not was["resolved"]
        if held["resolved"]:
            if armed:
                self.rearm(None)
        elif held["end_ms"] != had:
            if armed:
                self.rearm(held["end_ms"] + self.wait_ms)
            else:
                self.handle.registerTimer(held["end_ms"] + self.wait_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held()
        if not held or held["resolved"] or held["polls"] >= self.most:
            return
        due = expiredTimerInfo.getExpiryTimeInMs()
        held["polls"] += 1
        self.keep(**held)
        if held["polls"] < self.most:
            self.handle.registerTimer(due + self.again_ms)
        yield Row(condition_id=key[0], end_ms=held["end_ms"], polls=held["polls"], at_ms=due)


def due_polls(rows: DataFrame, wait_ms: int = 60_000, again_ms: int = 60_000, most: int = 1_000_000, time_mode: str = "ProcessingTime") -> DataFrame:
    """A row each time that a market's outcome is due. rows: a stream of (condition_id, end_ms, resolved): markets as they are
    discovered (resolved false) and outcomes as they come (end_ms null)."""
    known = rows.where("condition_id IS NOT NULL")
    return known.groupBy("condition_id").transformWithState(ResolutionWatch(wait_ms, again_ms, most), DUE, "Append", time_mode)


class Subscription(Keyed):
    """Listens to a token from `ahead` before its market's start to `behind` after its end."""

    fields = "start_ms long, end_ms long, active boolean"

    def __init__(self, ahead_ms: int, behind_ms: int):
        super().__init__()
        self.ahead_ms, self.behind_ms = ahead_ms, behind_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.held()
        spans = [(r["start_ms"], r["end_ms"]) for r in rows]
        if held:
            spans.append((held["start_ms"], held["end_ms"]))
        now = {"start_ms": min(s for s, _ in spans), "end_ms": max(e for _, e in spans), "active": bool(held and held["active"])}
        self.keep(**now)
        if not held or (held["start_ms"], held["end_ms"]) != (now["start_ms"], now["end_ms"]):
            self.rearm(now["end_ms"] + self.behind_ms + 1 if now["active"] else now["start_ms"] - self.ahead_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held()
        if not held:
            return
        due = expiredTimerInfo.getExpiryTimeInMs()
        if held["active"]:
            self.state.clear()  # a market that is over needs none
            yield Row(token=key[0], action="unsubscribe", at_ms=due)
        else:
            self.keep(**held | {"active": True})
            self.handle.registerTimer(held["end_ms"] + self.behind_ms + 1)
            yield Row(token=key[0], action="subscribe", at_ms=due)


def subscriptions(markets: DataFrame, ahead_ms: int = 60_000, behind_ms: int = 30_000, time_mode: str = "ProcessingTime") -> DataFrame:
    """Actions at their times. markets: a stream of (token, start_ms, end_ms) as they are discovered."""
    rows = markets.where("token IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL")
    return rows.groupBy("token").transformWithState(Subscription(ahead_ms, behind_ms), ACTION, "Append", time_mode)
