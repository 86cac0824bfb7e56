"""More queries by name, each with SQL that gives the same rows: contracts of snapshots, books, requests, results."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import book, metrics, snapshots, splits
from .plans import backtest
from .queries import _CUTOFF, DAY, ORACLE_SQL, QUERIES, query, sql
from .sources import requests, views

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Cutoffs within a day's market, in seconds.
OFFSETS = {"previous": 43_200, "signal": 64_800, "execution": 65_400}
_ASK = "(k + event_id % 7 - 1) / CAST(100 AS DOUBLE)"
_QUOTES = f"""quotes AS (SELECT user_id % 4 AS token, t - t % 86400 AS market_start_s, t % 86400 AS off, t, event_id, CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 'up' ELSE 'down' END AS side,
  k / CAST(100 AS DOUBLE) AS bid, {_ASK} AS ask FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
causal AS (SELECT token, market_start_s, {", ".join(f"arg_max({v}, t * 100000000 + event_id) FILTER (side = '{s}' AND off <= {OFFSETS[c]}) AS {c}_{s}_{v}" for c in snapshots.CUTOFFS for s in snapshots.SIDES for v in ("bid", "ask", "t"))}
  FROM quotes GROUP BY 1, 2),
complete AS (SELECT *, CASE WHEN {" OR ".join(f"{c}_{s}_t IS NULL" for c in snapshots.CUTOFFS for s in snapshots.SIDES)} THEN 'missing_causal_top'
  WHEN {" OR ".join(f"NOT ({c}_{s}_bid >= 0 AND {c}_{s}_bid <= {c}_{s}_ask AND {c}_{s}_ask <= 1 AND {c}_{s}_ask > 0)" for c in snapshots.CUTOFFS for s in snapshots.SIDES)} THEN 'invalid_causal_top' ELSE '' END AS invalid_reason FROM causal)"""


def _complete(spark, sf_dir):
    t = views._epoch("ts")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", t.alias("t"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    side = F.when(F.col("event_type").isin("purchase", "click", "view"), "up").otherwise("down")
    ask = (F.col("k") + F.col("event_id") % 7 - 1) / 100
    q = e.select((F.col("user_id") % 4).alias("token"), (F.col("t") - F.col("t") % DAY).alias("market_start_s"), (F.col("t") % DAY).alias("offset"), "t", "event_id", side.alias("side"), (F.col("k") / 100).alias("bid"), ask.alias("ask"))
    return snapshots.completed(snapshots.causal_quotes(q, ["token", "market_start_s"], OFFSETS, ["t", "event_id"]))


@query("q_causal_snapshots", f"""WITH {_QUOTES}, o AS (SELECT *, invalid_reason = '' AS ok FROM complete)
SELECT token, market_start_s, ok AS snapshot_valid, invalid_reason, round(CASE WHEN ok THEN (previous_up_bid + previous_up_ask) / 2 END, 6) AS previous_mid_up, round(CASE WHEN ok THEN (signal_up_bid + signal_up_ask) / 2 END, 6) AS mid_up,
  round(CASE WHEN ok THEN (signal_down_bid + signal_down_ask) / 2 END, 6) AS mid_down, round(CASE WHEN ok THEN 10 / execution_up_ask END, 6) AS execution_size_up, round(CASE WHEN ok THEN 10 / execution_down_ask END, 6) AS execution_size_down,
  CASE WHEN ok THEN least(previous_up_t, previous_down_t, signal_up_t, signal_down_t, execution_up_t, execution_down_t) END AS first_received FROM o""")
def causal_snapshots(spark, sf_dir):
    return _complete(spark, sf_dir).select("token", "market_start_s", "snapshot_valid", "invalid_reason", "previous_mid_up", "mid_up", "mid_down", "execution_size_up", "execution_size_down", "first_received")


@query("q_reason_counts", f"WITH {_QUOTES} SELECT invalid_reason, count(*) AS markets FROM complete GROUP BY 1")
def reason_counts(spark, sf_dir):
    return snapshots.reason_counts(_complete(spark, sf_dir), ["invalid_reason"])


@query("q_snapshot_bounds", f"""WITH {_QUOTES} SELECT coalesce(signal_up_bid BETWEEN 0 AND 1 AND signal_down_bid BETWEEN 0 AND 1 AND signal_up_ask > 0 AND signal_up_ask <= 1 AND signal_down_ask > 0 AND signal_down_ask <= 1
  AND signal_up_bid <= signal_up_ask AND signal_down_bid <= signal_down_ask AND (previous_up_bid + previous_up_ask) / 2 BETWEEN 0 AND 1 AND execution_up_ask > 0 AND execution_up_ask <= 1 AND execution_down_ask > 0 AND execution_down_ask <= 1, FALSE) AS bounded,
  count(*) AS markets FROM complete GROUP BY 1""")
def snapshot_bounds(spark, sf_dir):
    d = _complete(spark, sf_dir)
    of = lambda c, k: [F.col(f"{c}_{s}.{k}") for s in snapshots.SIDES]
    mid = (F.col("previous_up.bid") + F.col("previous_up.ask")) / 2
    return snapshots.reason_counts(d.withColumn("bounded", snapshots.bounded(of("signal", "bid"), of("signal", "ask"), mid, of("execution", "ask"))), ["bounded"])


@query("q_executable_size", sql("SELECT side, count(*) AS markets, sum(CASE WHEN size * price >= 10 THEN size ELSE 0 END) AS executable, count(*) FILTER (size * price >= 10) AS n FROM (SELECT condition_id, side, min(price) AS price, arg_min(size, price) AS size FROM depth GROUP BY 1, 2) GROUP BY 1", "depth", doubles="executable"))
def executable_size(spark, sf_dir):
    top = views.depth(spark, sf_dir).groupBy("condition_id", "side").agg(F.min("price").alias("price"), F.min_by("size", "price").alias("size"))
    size = snapshots.executable_size(F.col("size"), F.col("price"), 10.0)
    return top.withColumn("e", size).groupBy("side").agg(F.count(F.lit(1)).alias("markets"), F.sum("e").alias("executable"), F.count_if(F.col("e") > 0).alias("n"))


@query("q_book_digest", f"""SELECT token, sha256(string_agg(line, '' ORDER BY r, i)) AS digest, CAST(count(*) AS INT) AS levels FROM (SELECT token, CASE side WHEN 'bid' THEN 0 ELSE 1 END AS r, CAST(round(price * 100) AS INT) AS i,
  concat(CASE side WHEN 'bid' THEN 'B' ELSE 'A' END, ':', CAST(round(price * 100) AS INT), ':', size, chr(10)) AS line FROM ({ORACLE_SQL["q_book_depth_declarative"]})) GROUP BY 1""")
def book_digest(spark, sf_dir):
    return book.digest(book.depth_at(views.book_events(spark, sf_dir), _CUTOFF))


_CUTOFFS = [_CUTOFF + k * 5 * DAY * 1_000_000 for k in (-2, -1, 0, 1, 2)]


@query("q_book_many_cutoffs", " UNION ALL ".join(f"SELECT CAST({c} AS BIGINT) AS cutoff, * FROM ({ORACLE_SQL['q_book_depth_declarative'].replace(str(_CUTOFF), str(c))})" for c in _CUTOFFS))
def book_many_cutoffs(spark, sf_dir):
    return book.depth_at(views.book_events(spark, sf_dir), *_CUTOFFS)


@query("q_token_state", sql("SELECT token, arg_max(price, (t, event_id)) FILTER (kind = 'best_bid') AS tick_size, arg_max(size, (t, event_id)) FILTER (kind = 'best_ask') AS winner, count(*) FILTER (kind = 'best_bid') AS changes FROM book GROUP BY 1", "book"))
def token_state(spark, sf_dir):
    e = views.book_events(spark, sf_dir)
    kind = F.when(F.col("kind") == "best_bid", "tick_size").when(F.col("kind") == "best_ask", "resolved").otherwise(F.col("kind"))
    return book.token_state(e.withColumn("kind", kind))


@query("q_request_plan", """WITH b AS (SELECT CAST(floor(epoch(min(ts))) AS BIGINT) // 3600 * 3600 AS a, (CAST(floor(epoch(max(ts))) AS BIGINT) // 3600 + 1) * 3600 AS z FROM events)
  SELECT i AS index, CASE WHEN i < n THEN a + i * 3600 ELSE z - 3660 END AS start_s, CASE WHEN i < n THEN a + i * 3600 ELSE z - 3660 END + 3600 AS end_s FROM (SELECT a, z, (z - a) // 3600 - 1 AS n, unnest(range((z - a) // 3600)) AS i FROM b)""")
def request_plan(spark, sf_dir):
    """The requests that cover the time of the events, whose ends come from the table."""
    t = views._epoch("ts")
    b = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min(t).alias("a"), F.max(t).alias("z")).first()
    return requests.request_plan(spark, b["a"] // 3600 * 3600, (b["z"] // 3600 + 1) * 3600, 3600)


@query("q_turnover", sql("""SELECT split, fills, cash_turnover, net_pnl, max_drawdown, fills / greatest(days, CAST(1 AS DOUBLE) / 288) AS fills_per_day, CASE WHEN cash_turnover <> 0 THEN net_pnl / cash_turnover END AS return_on_turnover,
  CASE WHEN lost <> 0 THEN won / lost END AS profit_factor, won > 0 AND lost = 0 AS profit_factor_infinite FROM (SELECT split, count(*) FILTER (filled) AS fills, sum(CASE WHEN filled THEN fill_cost + platform_fee + extra_cost ELSE 0 END) AS cash_turnover,
  sum(net_pnl) AS net_pnl, max(peak - cum) AS max_drawdown, (max(market_start_s) - min(market_start_s)) / CAST(86400 AS DOUBLE) AS days, sum(greatest(net_pnl, 0)) AS won, sum(greatest(-net_pnl, 0)) AS lost FROM path GROUP BY 1)""", "path", doubles="cash_turnover net_pnl max_drawdown fills_per_day return_on_turnover profit_factor"))  # fmt: skip
def turnover(spark, sf_dir):
    return metrics.turnover(backtest.evaluated(spark, sf_dir), ["split"])


_STRESS = "CASE WHEN filled THEN net_pnl - CAST(0.01 AS DOUBLE) * fill_shares ELSE 0 END"


@query("q_holdout_metrics", sql(f"""SELECT split, fills, fill_fraction, net_pnl, half1_pnl, half2_pnl, stress_pnl, CASE WHEN lost <> 0 THEN won / lost END AS profit_factor, lost = 0 AND won > 0 AS profit_factor_infinite FROM (SELECT split, count(*) FILTER (filled) AS fills,
  avg(CAST(filled AS DOUBLE)) AS fill_fraction, sum(net_pnl) AS net_pnl, sum(greatest(net_pnl, 0)) AS won, sum(greatest(-net_pnl, 0)) AS lost, sum(CASE WHEN r <= n // 2 THEN net_pnl ELSE 0 END) AS half1_pnl, sum(CASE WHEN r > n // 2 THEN net_pnl ELSE 0 END) AS half2_pnl, sum({_STRESS}) AS stress_pnl
  FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY market_start_s, condition_id) AS r, count(*) OVER (PARTITION BY split) AS n FROM result) GROUP BY 1)""", "result", doubles="fill_fraction net_pnl half1_pnl half2_pnl stress_pnl profit_factor"))
def holdout_metrics(spark, sf_dir):
    d = backtest.evaluated(spark, sf_dir)
    d = d.withColumn("stress_pnl", F.when(F.col("filled"), F.col("net_pnl") - 0.01 * F.col("fill_shares")).otherwise(0.0))
    return metrics.holdout(splits.first_half(d, d, ["split"], ["market_start_s", "condition_id"]), ["split"])


@query("q_status_dense", sql("SELECT a.split, CAST(a.status AS INT) AS status, coalesce(b.n, 0) AS markets FROM (SELECT split, range AS status FROM (SELECT DISTINCT split FROM result), range(9)) a LEFT JOIN (SELECT split, status, count(*) AS n FROM result GROUP BY 1, 2) b USING (split, status)", "result"))
def status_dense(spark, sf_dir):
    d = backtest.evaluated(spark, sf_dir).groupBy("split").agg(*(F.count_if(F.col("status") == k).alias(f"s{k}") for k in range(9)))
    return d.select("split", F.explode(F.array(*(F.struct(F.lit(k).alias("status"), F.col(f"s{k}").alias("markets")) for k in range(9)))).alias("x")).select("split", "x.*")


@query("q_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("orders", "lineitem", "events")))
def table_counts(spark, sf_dir):
    out = None
    for t in ("orders", "lineitem", "events"):
        d = spark.read.parquet(f"{sf_dir}/{t}.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = d if out is None else out.unionByName(d)
    return out
