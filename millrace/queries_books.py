"""Queries over whole books: levels at many cutoffs, counts, digests in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import replay
from .queries import START, query
from .streaming import feeds
from .streaming import reference
from .streaming import replay as stream_replay

HOUR, SCALE = 3_600_000, 100
#: Five cutoffs over the sample month, in milliseconds.
CUTOFFS = [(START + d * 86_400) * 1000 for d in (3, 9, 9, 17, 30)]
CUTOFFS[2] += 1
LAST = CUTOFFS[-1]

_ROWS = f"""e AS (SELECT event_id, user_id % 7 AS condition_id, event_type AS kind, epoch_us(ts) // 1000 AS ms, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
r AS (SELECT condition_id, concat(condition_id, '-', k % 2) AS token, concat(condition_id, '-', 1 - k % 2) AS other_token, CASE WHEN kind = 'signup' AND k % 8 = 0 THEN 'book' WHEN kind = 'error' THEN 'last_trade_price' ELSE 'price_change' END AS event_type,
  ms // {HOUR} * {HOUR} AS receive_ms, ms AS source_ms, event_id AS source_row, [{{'tick': 30 + k % 7, 'size': value / 3}}, {{'tick': 35 + event_id % 5, 'size': value / 7}}, {{'tick': 40, 'size': CAST(0 AS DOUBLE)}}] AS bids, [{{'tick': 50 + k % 7, 'size': value / 9}}, {{'tick': 53 + event_id % 5, 'size': value / 11}}] AS asks,
  CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 20 + k % 60 AS tick, CASE WHEN CAST(floor(value) AS BIGINT) % 3 = 0 THEN 0 ELSE value / 3 END AS size, CASE WHEN k % 5 = 0 THEN 30 + event_id % 25 END AS best_bid, CASE WHEN k % 7 = 0 THEN 40 + event_id % 30 END AS best_ask FROM e WHERE ms // {HOUR} * {HOUR} <= {LAST})"""
_DEPTH = f"""{_ROWS},
o AS (SELECT *, receive_ms * 1048576 + CASE WHEN event_type = 'price_change' THEN 2 * others ELSE 2 * others - 1 END AS o FROM (SELECT *, CAST(sum(CAST(event_type <> 'price_change' AS INT)) OVER (PARTITION BY condition_id, receive_ms ORDER BY source_ms, source_row) AS BIGINT) AS others FROM r)),
f AS (SELECT condition_id, min(o) AS first_o, arg_min(token, o) AS first_token, arg_min(other_token, o) AS second_token FROM o WHERE event_type = 'book' GROUP BY 1),
x AS (SELECT o.*, first_o, first_token FROM o JOIN f USING (condition_id) WHERE o >= first_o),
b AS (SELECT condition_id, token, o, receive_ms, source_ms, source_row, 'BUY' AS side, unnest(bids) AS l, unnest(range(len(bids))) AS place FROM x WHERE event_type = 'book' UNION ALL SELECT condition_id, token, o, receive_ms, source_ms, source_row, 'SELL', unnest(asks), unnest(range(len(asks))) FROM x WHERE event_type = 'book'
  UNION ALL SELECT condition_id, other_token, o, receive_ms, source_ms, source_row, 'SELL', {{'tick': {SCALE} - l.tick, 'size': l.size}}, place FROM (SELECT *, unnest(bids) AS l, unnest(range(len(bids))) AS place FROM x WHERE event_type = 'book' AND o = first_o)
  UNION ALL SELECT condition_id, other_token, o, receive_ms, source_ms, source_row, 'BUY', {{'tick': {SCALE} - l.tick, 'size': l.size}}, place FROM (SELECT *, unnest(asks) AS l, unnest(range(len(asks))) AS place FROM x WHERE event_type = 'book' AND o = first_o)),
w AS (SELECT condition_id, token, side, l.tick AS tick, l.size AS size, o, receive_ms, source_ms, source_row, place FROM b UNION ALL SELECT condition_id, token, side, tick, size, o, receive_ms, source_ms, source_row, 0 FROM x WHERE event_type = 'price_change'),
s AS (SELECT condition_id, token, o, receive_ms FROM x WHERE event_type = 'book' UNION ALL SELECT condition_id, second_token, first_o, first_o // 1048576 FROM f),
q AS (SELECT *, min((source_ms, source_row)) OVER (PARTITION BY condition_id, token, o, side) AS seen FROM x WHERE event_type = 'price_change'),
h AS (SELECT condition_id, token, 'BUY' AS side, o, receive_ms, arg_max(best_bid, (seen, (source_ms, source_row))) AS hint FROM q WHERE best_bid IS NOT NULL GROUP BY ALL UNION ALL SELECT condition_id, token, 'SELL', o, receive_ms, arg_max(best_ask, (seen, (source_ms, source_row))) FROM q WHERE best_ask IS NOT NULL GROUP BY ALL),
c AS (SELECT unnest({CUTOFFS}) AS cutoff),
t AS (SELECT cutoff, condition_id, token, max(o) AS start FROM s JOIN c ON receive_ms <= cutoff GROUP BY ALL),
l AS (SELECT cutoff, w.condition_id, w.token, w.side, w.tick, arg_max({{'size': w.size, 'o': w.o}}, (w.o, w.source_ms, w.source_row, w.place)) AS v FROM w JOIN t ON t.condition_id = w.condition_id AND t.token = w.token AND w.receive_ms <= cutoff AND w.o >= start GROUP BY ALL),
d AS (SELECT cutoff, condition_id, token, side, tick, v.size AS size FROM l WHERE v.size > 0 AND NOT EXISTS (SELECT 1 FROM h WHERE h.condition_id = l.condition_id AND h.token = l.token AND h.side = l.side AND h.o >= l.v.o AND h.receive_ms <= l.cutoff AND CASE l.side WHEN 'BUY' THEN l.tick > h.hint ELSE l.tick < h.hint END))"""
_DIGEST = f"""{_DEPTH},
g AS (SELECT t.cutoff, t.token, sha256(coalesce(string_agg(concat(CASE side WHEN 'BUY' THEN 'B:' ELSE 'A:' END, tick, ':', printf('%.17g', size), chr(10)), '' ORDER BY side = 'SELL', tick) FILTER (tick IS NOT NULL), '')) AS digest FROM t LEFT JOIN d ON d.cutoff = t.cutoff AND d.token = t.token GROUP BY ALL),
p AS (SELECT cutoff, left(sha256(token), 2) AS part, count(*) AS tokens, sha256(string_agg(concat(token, ':', digest, chr(10)), '' ORDER BY token)) AS digest FROM g GROUP BY ALL),
z AS (SELECT cutoff, CAST(sum(tokens) AS BIGINT) AS tokens, sha256(string_agg(concat(part, ':', digest, chr(10)), '' ORDER BY part)) AS digest FROM p GROUP BY ALL)"""


def archive(events):
    """Archived rows of two-outcome markets from the sample events, batch or stream."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    k, e, v = F.get_json_object("props", "$.k").cast("long"), F.col("event_id"), F.col("value")
    condition = F.col("user_id") % 7
    level = lambda t, s: F.struct(t.cast("long").alias("tick"), s.cast("double").alias("size"))
    kind = F.when((F.col("event_type") == "signup") & (k % 8 == 0), "book").when(F.col("event_type") == "error", "last_trade_price").otherwise("price_change")
    return events.select(
        condition.alias("condition_id"), F.concat(condition.cast("string"), F.lit("-"), (k % 2).cast("string")).alias("token"), F.concat(condition.cast("string"), F.lit("-"), (1 - k % 2).cast("string")).alias("other_token"), kind.alias("event_type"),
        (F.floor(ms / HOUR).cast("long") * HOUR).alias("receive_ms"), ms.alias("source_ms"), e.alias("source_row"), F.array(level(30 + k % 7, v / 3), level(35 + e % 5, v / 7), level(F.lit(40), F.lit(0))).alias("bids"), F.array(level(50 + k % 7, v / 9), level(53 + e % 5, v / 11)).alias("asks"),
        F.when(e % 2 == 0, "BUY").otherwise("SELL").alias("side"), (20 + k % 60).alias("tick"), F.when(F.floor(v).cast("long") % 3 == 0, 0.0).otherwise(v / 3).alias("size"), F.when(k % 5 == 0, 30 + e % 25).alias("best_bid"), F.when(k % 7 == 0, 40 + e % 30).alias("best_ask"),
    ).where(F.col("receive_ms") <= LAST)


def _rows(spark, sf_dir):
    return archive(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("q_replay_depth", f"WITH {_DEPTH} SELECT cutoff, condition_id, token, side, tick, round(size, 6) AS size FROM d")
def replay_depth(spark, sf_dir):
    """Whole books at five cutoffs, in one pass."""
    return replay.depth_at(_rows(spark, sf_dir), CUTOFFS, SCALE).withColumn("size", F.round("size", 6))


@query("q_replay_counts", f"""WITH {_DEPTH}, n AS (SELECT cutoff, o.condition_id, first_o // 1048576 AS first_ms, count(*) AS event_rows, count(*) FILTER (event_type = 'price_change' AND o < first_o) AS ignored_rows FROM o JOIN f USING (condition_id) JOIN c ON receive_ms <= cutoff GROUP BY ALL)
  SELECT cutoff, condition_id, event_rows, ignored_rows, first_ms FROM n WHERE first_ms <= cutoff""")
def replay_counts(spark, sf_dir):
    return replay.counts_at(_rows(spark, sf_dir), CUTOFFS)


@query("q_replay_digest", f"WITH {_DIGEST} SELECT * FROM z")
def replay_digest(spark, sf_dir):
    """One digest of all books at each cutoff."""
    rows = _rows(spark, sf_dir)
    per = replay.digests(replay.depth_at(rows, CUTOFFS, SCALE), replay.started(rows, CUTOFFS), ["cutoff"])
    return replay.tree_digest(per, ["cutoff"])


@query("q_replay_status", f"WITH {_DIGEST} SELECT cutoff, tokens, digest, 'match' AS status FROM z WHERE cutoff = {LAST}")
def replay_status(spark, sf_dir):
    """The stream's books against the batch replay of the same rows: both digests, and whether they match."""
    reference.stateful(spark)
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if feeds._is_dir(spark, path) else path + "*")
    out = feeds.sunk(stream_replay.levels(archive(events), SCALE), "update")
    newest = out.groupBy("condition_id").agg(F.max("epoch").alias("epoch"))
    now = out.join(newest, ["condition_id", "epoch"]).withColumn("cutoff", F.lit(LAST).cast("long"))
    live = replay.tree_digest(replay.digests(now.where("side IS NOT NULL"), now.where("side IS NULL"), ["cutoff"]), ["cutoff"])
    rows = _rows(spark, sf_dir)
    again = replay.tree_digest(replay.digests(replay.depth_at(rows, [LAST], SCALE), replay.started(rows, [LAST]), ["cutoff"]), ["cutoff"])
    return live.join(replay.outcome(again, live, ["cutoff"]), "cutoff")
