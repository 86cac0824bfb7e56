"""Decisions of an early source with bounds on staleness."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans import early
from .queries import START, query
from .sources import views

#: Seconds at which the sample's ticks stand: at, one and two seconds off the cutoffs.
SECONDS = [238, 239, 240, 268, 269, 270, 271, 272, 273]
T = early.Times()
_TICKS = f"""t AS (SELECT user_id * 4 + k % 4 AS market_id, {START} + (user_id * 4 + k % 4) * 300 AS market_start_s, ({START} + (user_id * 4 + k % 4) * 300) * 1000 + s * 1000 + k * 20 AS ts, event_id AS row_id, s * 1000 + k * 20 AS off, (k + 1) / CAST(100 AS DOUBLE) - CAST(0.01 AS DOUBLE) * (event_id % 3) AS bid_up, (k + 1) / CAST(100 AS DOUBLE) AS ask_up,
  CASE WHEN event_type <> 'error' THEN (99 - k) / CAST(100 AS DOUBLE) END AS bid_down, (100 - k) / CAST(100 AS DOUBLE) AS ask_down, value AS size_up, CASE WHEN event_id % 11 > 0 THEN value / 2 END AS size_down
  FROM (SELECT *, {SECONDS}[event_id % {len(SECONDS)} + 1] AS s FROM (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)))"""


def _ticks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", views._k().alias("k"))
    second = F.element_at(F.array(*map(F.lit, SECONDS)), (F.col("event_id") % len(SECONDS) + 1).cast("int"))
    k = F.col("k")
    e = e.withColumn("market_id", F.col("user_id") * 4 + k % 4).withColumn("market_start_s", F.lit(START) + F.col("market_id") * 300)
    return e.select(
        "market_id", "market_start_s", (F.col("market_start_s") * 1000 + second * 1000 + k * 20).alias("ts"), F.col("event_id").alias("row_id"), ((k + 1) / 100 - F.lit(0.01) * (F.col("event_id") % 3)).alias("bid_up"), ((k + 1) / 100).alias("ask_up"),
        F.when(F.col("event_type") != "error", (99 - k) / 100).alias("bid_down"), ((100 - k) / 100).alias("ask_down"), F.col("value").alias("size_up"), F.when(F.col("event_id") % 11 > 0, F.col("value") / 2).alias("size_down"),
    )


_Q = "bid_up IS NOT NULL AND ask_up IS NOT NULL AND bid_down IS NOT NULL AND ask_down IS NOT NULL"
_X = "ask_up IS NOT NULL AND ask_down IS NOT NULL AND size_up IS NOT NULL AND size_down IS NOT NULL"


@query("q_early_batch", f"""WITH {_TICKS}, q AS (SELECT market_id, market_start_s, count(*) AS n_ticks, {", ".join(f"arg_max({c}, (off, row_id)) FILTER ({_Q} AND off <= {ms}) AS {n}_{c}" for n, ms in (("p", T.previous_ms), ("c", T.decision_ms)) for c in ("ts", "bid_up", "ask_up", "bid_down", "ask_down"))},
  {", ".join(f"arg_min({c}, (off, row_id)) FILTER ({_X} AND off >= {T.execution_ms}) AS x_{c}" for c in ("ts", "ask_up", "ask_down", "size_up", "size_down"))} FROM t GROUP BY 1, 2),
  f AS (SELECT *, coalesce(market_start_s * 1000 + {T.previous_ms} - p_ts <= {T.stale_ms} AND market_start_s * 1000 + {T.decision_ms} - c_ts <= {T.stale_ms} AND x_ts - market_start_s * 1000 - {T.execution_ms} <= {T.stale_ms}, FALSE) AS timely FROM q)
  SELECT market_id, concat('m', market_id) AS condition_id, CAST(market_id % 2 AS DOUBLE) AS outcome_up, n_ticks, timely, timely AND c_bid_up BETWEEN 0 AND 1 AND c_bid_down BETWEEN 0 AND 1 AND c_ask_up > 0 AND c_ask_up <= 1 AND c_ask_down > 0 AND c_ask_down <= 1 AND x_ask_up > 0 AND x_ask_up <= 1 AND x_ask_down > 0 AND x_ask_down <= 1 AND c_bid_up <= c_ask_up AND c_bid_down <= c_ask_down AS snapshot_valid,
  round((p_bid_up + p_ask_up) / 2, 6) AS previous_mid_up, round((c_bid_up + c_ask_up) / 2, 6) AS mid_up, round((c_bid_down + c_ask_down) / 2, 6) AS mid_down, round(CASE WHEN x_size_up * x_ask_up >= 10 THEN x_size_up WHEN x_size_up IS NOT NULL THEN 0 END, 6) AS size_up, round(CASE WHEN x_size_down * x_ask_down >= 10 THEN x_size_down WHEN x_size_down IS NOT NULL THEN 0 END, 6) AS size_down FROM f""")
def early_batch(spark, sf_dir):
    """Quotes at most a second off, in both directions, in one pass over the ticks."""
    ticks = _ticks(spark, sf_dir)
    labels = ticks.select("market_id").distinct().select("market_id", F.concat(F.lit("m"), F.col("market_id").cast("string")).alias("condition_id"), (F.col("market_id") % 2).cast("double").alias("outcome_up"))
    return early.batch(ticks, labels).select("market_id", "condition_id", "outcome_up", "n_ticks", "timely", "snapshot_valid", "previous_mid_up", "mid_up", "mid_down", "size_up", "size_down")
