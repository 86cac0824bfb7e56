"""Decisions from an early source: one aggregate per market gives the quotes before two cutoffs and the first after a third,
each with the time that it was seen, and a bound on how stale it may be.

Ticks: market_id, market_start_s, ts (milliseconds), bid_up, ask_up, bid_down, ask_down, size_up, size_down. A quote has all four
prices; an execution quote has both asks and sizes. Outcomes come from labels, one for each market.

Defined results: a market without a usable quote at a cutoff has NULLs there and isn't valid; of ticks at one time the greatest
(before a cutoff) or least (after it) row id counts; a market without a label, or fewer markets than the least share of those
declared, is an error; no ticks and no declared markets give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



class CoverageError(ValueError):
    """Markets are missing."""


@dataclass(frozen=True)
class Times:
    """Offsets into a market in milliseconds, how far off a quote may be, and the money to spend."""

    previous_ms: int = 240_000
    decision_ms: int = 270_000
    execution_ms: int = 271_000
    stale_ms: int = 1_000
    target: float = 10.0


def quotes(ticks: DataFrame, times: Times = Times()) -> DataFrame:
    """(market_id, market_start_s, n_ticks, previous, current, execution) with a struct of each cutoff's quote and its ts."""
    top = ["bid_up", "ask_up", "bid_down", "ask_down"]
    whole = lambda names: F.when(sum((F.col(c).isNull() | F.isnan(c)).cast("int") for c in names) == 0, F.lit(True))
    t = ticks.withColumns({"offset": F.col("ts") - F.col("market_start_s") * 1000, "has_top": whole(top), "has_execution": whole(["ask_up", "ask_down", "size_up", "size_down"])})
    order = F.struct("offset", "row_id")
    before = lambda c: F.col("has_top") & (F.col("offset") <= c)
    after = F.col("has_execution") & (F.col("offset") >= times.execution_ms)
    last = lambda name, c: F.max_by(F.struct("ts", *top), F.when(before(c), order)).alias(name)
    first = F.min_by(F.struct("ts", "ask_up", "ask_down", "size_up", "size_down"), F.when(after, order)).alias("execution")
    return t.groupBy("market_id", "market_start_s").agg(F.count(F.lit(1)).alias("n_ticks"), last("previous", times.previous_ms), last("current", times.decision_ms), first)


def batch(ticks: DataFrame, labels: DataFrame, times: Times = Times()) -> DataFrame:
    """A decision a market. labels: (market_id, condition_id, outcome_up)."""
    q = quotes(ticks, times)
    at = lambda ms: F.col("market_start_s") * 1000 + ms
    near = lambda c, ms, sign: F.coalesce((F.col(f"{c}.ts") - at(ms)) * sign <= times.stale_ms, F.lit(False)) & ((F.col(f"{c}.ts") - at(ms)) * sign >= 0)
    timely = near("previous", times.previous_ms, -1) & near("current", times.decision_ms, -1) & near("execution", times.execution_ms, 1)
    bids, asks = [F.col(f"current.bid_{s}") for s in ("up", "down")], [F.col(f"current.ask_{s}") for s in ("up", "down")]
    bought, sizes = [F.col(f"execution.ask_{s}") for s in ("up", "down")], [F.col(f"execution.size_{s}") for s in ("up", "down")]
    rules = [timely, *(b.between(0, 1) for b in bids), *((a > 0) & (a <= 1) for a in (*asks, *bought)), *((s >= 0) & (s < float("inf")) for s in sizes), *(b <= a for b, a in zip(bids, asks, strict=True))]
    valid = F.lit(True)
    for r in rules:
        valid &= F.coalesce(r, F.lit(False))
    mid = lambda c, s: (F.col(f"{c}.bid_{s}") + F.col(f"{c}.ask_{s}")) / 2
    size = lambda s: F.when(F.col(f"execution.size_{s}") * F.col(f"execution.ask_{s}") >= times.target, F.col(f"execution.size_{s}")).when(F.col(f"execution.size_{s}").isNotNull(), 0.0)
    return q.join(labels, "market_id", "left").select(
        "market_id", "condition_id", "market_start_s", "outcome_up", "n_ticks", F.coalesce(timely, F.lit(False)).alias("timely"), valid.alias("snapshot_valid"), mid("previous", "up").alias("previous_mid_up"), mid("current", "up").alias("mid_up"), mid("current", "down").alias("mid_down"),
        bids[0].alias("bid_up"), bids[1].alias("bid_down"), asks[0].alias("ask_up"), asks[1].alias("ask_down"), bought[0].alias("execution_ask_up"), bought[1].alias("execution_ask_down"), size("up").alias("size_up"), size("down").alias("size_down"),
    )


def checked(decisions: DataFrame, declared: DataFrame, least_share: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """(decisions, declared markets without ticks), after the checks: each market has an outcome and stands once, and enough
    of the declared ones are there. One aggregate."""
    missing = declared.select("market_id").join(decisions, "market_id", "left_anti")
    r = decisions.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("market_id").alias("ids"), F.count_if(F.col("outcome_up").isNull()).alias("bare")).first()
    if r["bare"]:
        raise CoverageError(f"{r['bare']} markets have no outcome")
    if r["n"] != r["ids"]:
        raise CoverageError("a market stands more than once")
    n = declared.select("market_id").distinct().count()
    if n and r["n"] / n < least_share:
        raise CoverageError(f"{r['n']} of {n} markets, below {least_share:.3%}")
    return decisions, missing
