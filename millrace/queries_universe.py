"""Raw event documents parsed into market records and rejects."""

from __future__ import annotations

from pyspark.sql import functions as F

from .queries import query
from .sources import universe

#: Markets of 1996 and 1997, five minutes long.
SCOPE = universe.Scope(820_454_400_000, 883_612_800_000, 300)
_BASE = "o AS (SELECT o_orderkey AS k, CAST(floor(epoch(o_orderdate)) AS BIGINT) * 1000 AS s, o_orderpriority AS p, o_orderstatus AS status, o_totalprice AS price FROM orders)"


def documents(spark, sf_dir):
    """(doc_key, raw): an event document of each order, as a feed would send it, faults included."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, s = F.col("o_orderkey"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    at = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss")
    length = F.when(k % 31 == 3, 600).otherwise(300)
    quote = F.lit('"')
    text = lambda c: F.concat(quote, c, quote)
    outcomes = F.when(k % 37 == 5, F.lit('["Yes","No"]')).when(k % 2 == 0, F.lit('["Up","Down"]')).otherwise(F.lit('"[\\"Up\\", \\"Down\\"]"'))
    prices = F.when(F.col("o_orderstatus") == "F", F.lit('["1","0"]')).when(F.col("o_orderstatus") == "O", F.lit('"[\\"0\\", \\"1\\"]"')).otherwise(F.lit('["0.4","0.6"]'))
    fees = F.when(k % 3 == 0, F.concat(F.lit('"feesEnabled":true,"feeSchedule":{'), F.when(k % 41 == 0, F.lit('"exponent":1')).otherwise(F.concat(F.lit('"rate":'), F.when(k % 43 == 0, F.lit("-0.1")).otherwise(F.lit("0.0625")), F.lit(',"exponent":1,"takerOnly":true'))), F.lit("},"))).otherwise(F.lit('"feesEnabled":false,'))
    condition = F.concat(F.lit("0X"), F.lpad(F.conv(k.cast("string"), 10, 16), 64, "0"))
    market = F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"outcomes":'), outcomes, F.lit(',"clobTokenIds":["'), (k * 2).cast("string"), F.lit('","'), (k * 2 + 1).cast("string"), F.lit('"],"outcomePrices":'), prices, F.lit(","), fees, F.lit('"conditionId":'), text(F.when(k % 47 == 1, "0x12").otherwise(condition)), F.lit("}"))
    markets = F.when(k % 53 == 2, F.concat(F.lit("["), market, F.lit(","), market, F.lit("]"))).otherwise(F.concat(F.lit("["), market, F.lit("]")))
    end = F.concat(at(s + length), F.when(k % 59 == 4, "").otherwise("Z"))
    start = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"startTime":"'), at(s), F.lit('Z",')))
    raw = F.concat(F.lit('{"id":"e'), k.cast("string"), F.lit('","slug":"market-'), k.cast("string"), F.lit('",'), start, F.lit('"endDate":'), text(end), F.lit(',"markets":'), markets, F.lit("}"))
    return o.select(k.alias("doc_key"), F.when(k % 61 == 7, F.substring(raw, 1, 40)).otherwise(raw).alias("raw"))


_REASON = """CASE WHEN k % 61 = 7 THEN 'not JSON' WHEN k % 59 = 4 THEN 'end time is missing or has no zone' WHEN CASE WHEN k % 5 = 0 AND k % 31 = 3 THEN s + 300000 ELSE s END NOT BETWEEN 820454400000 AND 883612799999 THEN 'outside the period' WHEN k % 31 = 3 AND k % 5 <> 0 THEN 'unexpected duration'
  WHEN k % 53 = 2 THEN 'not one market' WHEN k % 37 = 5 THEN 'unexpected outcome mapping' WHEN status NOT IN ('F', 'O') THEN 'not settled' WHEN k % 3 = 0 AND k % 41 = 0 THEN 'fees without a rate' WHEN k % 3 = 0 AND k % 43 = 0 THEN 'unsupported fee schedule' WHEN k % 47 = 1 THEN 'invalid condition id' END"""


@query("q_universe_rows", f"""WITH {_BASE}, r AS (SELECT *, {_REASON} AS reason FROM o) SELECT concat('e', k) AS event_id, CAST(k AS VARCHAR) AS market_id, concat('market-', k) AS slug, concat('0x', lpad(lower(hex(k)), 64, '0')) AS condition_id, CAST(k * 2 AS VARCHAR) AS token_up, CAST(k * 2 + 1 AS VARCHAR) AS token_down,
  CASE WHEN k % 5 = 0 AND k % 31 = 3 THEN s + 300000 ELSE s END AS market_start_ms, CASE WHEN k % 31 = 3 THEN s + 600000 ELSE s + 300000 END AS market_end_ms, CASE status WHEN 'F' THEN 1.0 ELSE 0.0 END AS outcome_up, CASE WHEN k % 3 = 0 THEN 0.0625 ELSE 0.0 END AS fee_rate, k % 3 = 0 AS fees_enabled FROM r WHERE reason IS NULL""")
def universe_rows(spark, sf_dir):
    rows, _ = universe.markets(documents(spark, sf_dir), "raw", SCOPE)
    return rows.select("event_id", "market_id", "slug", "condition_id", "token_up", "token_down", "market_start_ms", "market_end_ms", "outcome_up", "fee_rate", "fees_enabled")


@query("q_universe_rejects", f"WITH {_BASE} SELECT k AS doc_key, {_REASON} AS reason FROM o WHERE {_REASON} IS NOT NULL")
def universe_rejects(spark, sf_dir):
    _, rejects = universe.markets(documents(spark, sf_dir), "raw", SCOPE)
    return rejects.select("doc_key", "reason")
