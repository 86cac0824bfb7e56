"""The market tables as views of the sample star schema: one function each, columns pruned at the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400
#: Lines of books that a task groups.
ROWS = 250_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch(c: str) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0)
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("condition_id"), F.col("o_orderpriority").alias("asset"), _epoch("o_orderdate").alias("market_start_s"), outcome.alias("outcome_up"))


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ask ladder: a row per market, side (0 up, 1 down) and price. Markets are dealt to as many tasks as keep each at about
    ROWS lines, so that a task's tables stay the same size on any input; what is grouped by market then needs no other shuffle."""
    side = F.when(F.col("l_linestatus") == "O", 0).otherwise(1)
    price = F.greatest(F.floor(F.col("l_extendedprice") / 1100), F.lit(1)).cast("double") / 100
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("condition_id"), side.alias("side"), price.alias("price"), F.col("l_quantity").alias("size"))
    n = max(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    return rows.repartition(n, "condition_id").groupBy("condition_id", "side", "price").agg(F.sum("size").alias("size"))


def tops(ladder: DataFrame) -> DataFrame:
    """Top of book of each market from its ladder."""
    of = lambda f, side: f(F.when(F.col("side") == side, F.col("price")))
    t = ladder.groupBy("condition_id").agg(of(F.min, 0).alias("ask_up"), of(F.min, 1).alias("ask_down"), of(F.max, 0).alias("previous_mid_up"))
    bid = lambda c: F.greatest(F.col(c) - 0.01, F.lit(0.0))
    t = t.withColumns({"bid_up": F.when(F.col("ask_up").isNotNull(), bid("ask_up")), "bid_down": F.when(F.col("ask_down").isNotNull(), bid("ask_down"))})
    return t.withColumns({"mid_up": (F.col("bid_up") + F.col("ask_up")) / 2, "mid_down": (F.col("bid_down") + F.col("ask_down")) / 2, "snapshot_valid": F.col("ask_up").isNotNull() & F.col("ask_down").isNotNull()})


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markets(spark, sf_dir).join(tops(depth(spark, sf_dir)), "condition_id")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", _epoch("ts").alias("t"), "event_type", "value")
    return e.withColumn("market_start_s", F.col("t") - F.col("t") % DAY)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", _epoch("ts").alias("t"), "event_type", "value", _k().alias("k"))
    kind = F.when(F.col("event_type") == "purchase", "TRADE").when(F.col("event_type") == "click", "SPLIT").when(F.col("event_type") == "view", "REDEEM").when(F.col("event_type") == "signup", "MERGE").otherwise("REWARD")
    return e.select(
        "event_id", (F.col("user_id") % 3).alias("account_id"), (F.col("user_id") * 10 + F.col("k") % 10).alias("condition_id"), "t", kind.alias("activity_type"),
        F.when(F.col("k") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("value").alias("usdc_size"), (F.col("k") / 100).alias("price"),
    )


def book_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order: t (microseconds), then event_id."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type") == "signup", "snapshot").when(F.col("event_type") == "purchase", "bid").when(F.col("event_type") == "click", "ask").when(F.col("event_type") == "view", "best_bid").otherwise("best_ask")
    return _read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("token"), us.alias("t"), kind.alias("kind"), (_k() / 100).alias("price"), (F.floor("value") % 5).cast("long").alias("size"))
