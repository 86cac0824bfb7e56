"""Queries over stored rows that are read as streams, with keyed state and timers in event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from .queries import START, query
from .sources import views
from .streaming import feeds, reference

HOUR = 3_600_000
#: How far behind the newest row the watermark stays, in hours; a feed is silent, and an outcome due, after so many ms.
DELAY, SILENT, WAIT = 1, 6 * HOUR, HOUR
STEP = 600_000
_MS = "(epoch_us(ts) // 1000)"
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _events(spark, sf_dir):
    """(event_id, ts, user_id, event_type, value, k, ms) as a stream with a watermark."""
    reference.stateful(spark)
    path = f"{sf_dir}/events.parquet"
    e = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if feeds._is_dir(spark, path) else path + "*")
    at = F.col("ts").cast("timestamp")
    return e.select("event_id", at.alias("at"), "user_id", "event_type", "value", views._k().alias("k"), F.unix_millis(at).alias("ms")).withWatermark("at", f"{DELAY} hours")


@query("q_stream_boundaries", f"""WITH p AS (SELECT event_type AS topic, CAST(user_id % 3 AS VARCHAR) AS symbol, {_MS} // {STEP} * {STEP} AS start_ms, CASE WHEN {_K} % 4 = 0 THEN value + 1 ELSE value END AS value, {_K} % 4 = 0 AS exact, {_MS} AS ms, event_id FROM events),
  b AS (SELECT topic, symbol, start_ms, arg_min({{'value': value, 'exact': exact}}, (NOT exact, ms, event_id)) AS r FROM p GROUP BY 1, 2, 3),
  m AS (SELECT o_orderkey AS condition_id, ['view', 'click', 'signup', 'purchase', 'error'][o_orderkey % 5 + 1] AS topic, CAST(o_custkey % 3 AS VARCHAR) AS symbol, {START}000 + (o_orderkey * 37 % 4320) * {STEP} AS start_ms FROM orders)
  SELECT condition_id, topic, symbol, start_ms, round(r.value, 6) AS value, coalesce(r.exact, FALSE) AS exact FROM m LEFT JOIN b USING (topic, symbol, start_ms)""")
def stream_boundaries(spark, sf_dir):
    """Values at market boundaries from the stream of points; boundaries without one keep NULL."""
    exact = F.when(F.col("k") % 4 == 0, F.col("value") + 1)
    step = F.call_function("div", F.col("ms"), F.lit(STEP)) * STEP
    points = _events(spark, sf_dir).select(F.col("event_type").alias("topic"), (F.col("user_id") % 3).cast("string").alias("symbol"), step.alias("timestamp_ms"), "value", exact.alias("exact_value"), F.col("ms").alias("received_ms"), "event_id")
    topics = F.array(*map(F.lit, ("view", "click", "signup", "purchase", "error")))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    markets = o.select(F.col("o_orderkey").alias("condition_id"), topics[(F.col("o_orderkey") % 5).cast("int")].alias("topic"), (F.col("o_custkey") % 3).cast("string").alias("symbol"), (F.lit(START * 1000) + F.col("o_orderkey") * 37 % 4320 * STEP).alias("start_ms"))
    matches = feeds.sunk(reference.boundary_matches(points, markets), "update")
    return reference.boundary_values(matches, markets).withColumn("value", F.round("value", 6))


@query("q_stream_stale", f"""WITH f AS (SELECT concat(event_type, ':', user_id % 500) AS feed, max({_MS}) AS last_ms FROM events GROUP BY 1), w AS (SELECT max({_MS}) - {DELAY * HOUR} AS now_ms FROM events)
  SELECT feed, last_ms + {SILENT} < now_ms AS stale, CASE WHEN last_ms + {SILENT} < now_ms THEN last_ms END AS silent_since FROM f, w""")
def stream_stale(spark, sf_dir):
    """Which feeds are silent at the watermark: their timers fire without a message of their own."""
    feed = F.concat("event_type", F.lit(":"), (F.col("user_id") % 500).cast("string"))
    messages = _events(spark, sf_dir).select(feed.alias("feed"), F.col("ms").alias("received_ms"), "at")
    last = feeds.drain(reference.feed_states(messages, SILENT, "EventTime"), "update", "feed")
    return last.select("feed", "stale", F.when(F.col("stale"), F.col("last_ms")).alias("silent_since"))


@query("q_stream_due", f"""WITH u AS (SELECT user_id * 10 + {_K} % 10 AS condition_id, max({_MS} + {_K} % 24 * {HOUR}) FILTER (event_type = 'signup') AS end_ms, bool_or(event_type = 'error' AND {_K} >= 60) AS resolved FROM events GROUP BY 1), w AS (SELECT max({_MS}) - {DELAY * HOUR} AS now_ms FROM events)
  SELECT condition_id, end_ms, CAST(1 AS BIGINT) AS polls, end_ms + {WAIT} AS at_ms FROM u, w WHERE NOT resolved AND end_ms + {WAIT} <= now_ms""")
def stream_due(spark, sf_dir):
    """Markets whose outcome is due: ended WAIT before the watermark and without one."""
    e = _events(spark, sf_dir)
    end = F.when(F.col("event_type") == "signup", F.col("ms") + F.col("k") % 24 * HOUR)
    rows = e.select((F.col("user_id") * 10 + F.col("k") % 10).alias("condition_id"), end.alias("end_ms"), ((F.col("event_type") == "error") & (F.col("k") >= 60)).alias("resolved"), "at")
    # Other rows tell nothing of a market. The condition names the event time, so that it stays above the watermark, which all rows move.
    rows = rows.where("at IS NULL OR end_ms IS NOT NULL OR resolved")
    return feeds.sunk(reference.due_polls(rows, WAIT, WAIT, 1, "EventTime"), "append").select("condition_id", "end_ms", "polls", "at_ms")
