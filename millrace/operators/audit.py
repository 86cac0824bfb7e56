"""Reconciliation of an activity ledger: cash flows, sliding windows, behaviour, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import joins

# Activity kinds.
REWARDS = ("REWARD", "MAKER_REBATE", "TAKER_REBATE", "REFERRAL_REWARD", "YIELD")
SETTLED = ("TRADE", "SPLIT", "REDEEM", "MERGE")


def signed_cash() -> Column:
    a = F.col("usdc_size")
    k = F.col("activity_type")
    return F.when((k == "TRADE") & (F.col("side") == "BUY"), -a).when((k == "TRADE") & (F.col("side") == "SELL"), a).when(k == "SPLIT", -a).when(k.isin("MERGE", "REDEEM", *REWARDS), a).otherwise(0.0)


def reward_cash() -> Column:
    return F.when(F.col("activity_type").isin(*REWARDS), F.col("usdc_size")).otherwise(0.0)


def with_cash(activity: DataFrame) -> DataFrame:
    return activity.withColumns({"cash_flow": signed_cash(), "reward_cash": reward_cash()})


def settled(activity: DataFrame) -> DataFrame:
    """Profit of each market that was redeemed or merged, at its last activity."""
    d = with_cash(activity).where(F.col("activity_type").isin(*SETTLED) & F.col("condition_id").isNotNull())
    closed = F.max(F.when(F.col("activity_type").isin("REDEEM", "MERGE"), 1).otherwise(0)).alias("closed")
    return d.groupBy("account_id", "condition_id").agg(F.max("t").alias("close_t"), F.sum("cash_flow").alias("pnl"), closed).where("closed = 1").drop("closed")


def window_metrics(activity: DataFrame, start: int, end: int, days: int) -> DataFrame:
    """Per account and daily-stepped window: cash flow, rewards, trades, settled markets and profit,
    largest win, and markets whose trading span overlaps the window."""
    spark = activity.sparkSession
    a = with_cash(activity).withColumns({"trades": (F.col("activity_type") == "TRADE").cast("long")})
    flows = joins.range_sums(a, "t", ["cash_flow", "reward_cash", "trades"], start, end, days, ["account_id"])
    s = settled(activity)
    s = s.where(F.col("close_t").between(start, end)).withColumn("day", F.floor((F.col("close_t") - start) / joins.DAY).cast("long"))
    daily = s.groupBy("account_id", "day").agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("resolved"), F.max("pnl").alias("biggest"))
    n = max(0, (end - days * joins.DAY + 1 - start) // joins.DAY + 1)
    lo, hi = F.greatest(F.lit(0), F.col("day") - days + 1), F.least(F.lit(n - 1), F.col("day"))
    won = daily.where(lo <= hi).withColumn("window_id", F.explode(F.sequence(lo, hi))).groupBy("account_id", "window_id").agg(F.sum("pnl").alias("pnl"), F.sum("resolved").alias("resolved"), F.max("biggest").alias("biggest_win"))
    spans = activity.where((F.col("activity_type") == "TRADE") & F.col("condition_id").isNotNull()).groupBy("account_id", "condition_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    over = joins.overlap_counts(spans, "first_t", "last_t", start, end, days, ["account_id"]).withColumnRenamed("n", "unique_markets")
    spine = activity.select("account_id").distinct().crossJoin(F.broadcast(joins.daily_windows(spark, start, end, days)))  # windows: the days of the period
    d = spine.join(flows, ["account_id", "window_id"], "left").join(won, ["account_id", "window_id"], "left").join(over, ["account_id", "window_id"], "left")
    return d.na.fill(0, ["cash_flow", "reward_cash", "trades", "pnl", "resolved", "biggest_win", "unique_markets"])


def behaviour(activity: DataFrame) -> DataFrame:
    """Per account: trades, markets, sides and exact quantiles of price and size."""
    t = activity.where(F.col("activity_type") == "TRADE")
    q = lambda c: [F.percentile(c, F.lit(x)).alias(f"{c}_p{int(100 * x)}") for x in (0.1, 0.5, 0.9)]
    return t.groupBy("account_id").agg(F.count(F.lit(1)).alias("trade_rows"), F.count_distinct("condition_id").alias("unique_markets"), F.count_if(F.col("side") == "BUY").alias("buys"), F.count_if(F.col("side") == "SELL").alias("sells"), *q("price"), *q("usdc_size"))


def claim_distance(windows: DataFrame, pnl: float, predictions: int, biggest: float, pnl_tolerance: float, win_tolerance: float) -> DataFrame:
    """How near each window is to a claimed result: of two definitions of profit the nearer, of the
    counts the nearest, and the largest win, each relative to the claim."""
    gap = lambda c: F.abs(c - F.lit(pnl))
    plain, more = F.col("pnl"), F.col("pnl") + F.col("reward_cash")
    counts = [F.col(c) for c in ("trades", "unique_markets", "resolved")]
    near = F.when(gap(plain) <= gap(more), plain).otherwise(more)
    away = F.least(*(F.abs(c - predictions) for c in counts))
    d = gap(near) / max(abs(pnl), 1.0) + away / max(predictions, 1) + F.abs(F.col("biggest_win") - biggest) / max(abs(biggest), 1.0)
    names = F.concat_ws(",", *(F.when(c == predictions, F.lit(n)) for c, n in zip(counts, ("trades", "unique_markets", "resolved"), strict=True)))
    matched = gap(near) <= pnl_tolerance
    won = F.abs(F.col("biggest_win") - biggest) <= win_tolerance
    return windows.withColumns({"nearest_pnl": near, "matching_counts": names, "pnl_match": matched, "win_match": won, "distance": d}).withColumn("joint_match", F.col("pnl_match") & F.col("win_match") & (F.col("matching_counts") != ""))


def best_claim(windows: DataFrame) -> DataFrame:
    """Per account the window nearest to the claim, and whether any matches wholly."""
    best = F.min_by(F.struct("window_id", "distance", "nearest_pnl"), F.struct("distance", "window_id"))
    return windows.groupBy("account_id").agg(best.alias("b"), F.bool_or("joint_match").alias("verified"), F.count_if("pnl_match").alias("pnl_matches")).select("account_id", "b.*", "verified", "pnl_matches")


def exact_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with their hash, one of each: equal hashes are equal rows, so which stays is no matter."""
    return df.withColumn("row_hash", S.canonical_hash(*columns)).dropDuplicates(["row_hash"])


def upsert(existing: DataFrame | None, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: those whose keys are not there yet, each once."""
    new = rows.dropDuplicates(keys)
    return new if existing is None else new.join(existing.select(*keys), keys, "left_anti")
