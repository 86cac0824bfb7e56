"""The snapshot contract: causal quotes at three cutoffs, completeness with a reason, bounds, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a market needs: a quote of both sides at every cutoff.
CUTOFFS, SIDES = ("previous", "signal", "execution"), ("up", "down")
#: Notional that sizes are assumed for where a source has quotes without sizes.
NOTIONAL = 10.0


def causal_quotes(quotes: DataFrame, keys: list[str], offsets: dict[str, int], order: list[str]) -> DataFrame:
    """A row per market with the last quote of each side at or before each cutoff, as structs (bid, ask, t) named
    <cutoff>_<side>. quotes: keys, side, t, offset (time within the market), bid, ask. One aggregate,
    pre-aggregated before the shuffle."""
    last = F.struct("bid", "ask", "t")
    return quotes.groupBy(*keys).agg(*(F.max_by(F.when((F.col("side") == s) & (F.col("offset") <= offsets[c]), last), F.when((F.col("side") == s) & (F.col("offset") <= offsets[c]), F.struct(*order))).alias(f"{c}_{s}") for c in CUTOFFS for s in SIDES))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def completed(causal: DataFrame) -> DataFrame:
    """Adds snapshot_valid, invalid_reason and, where valid, mids, signal quotes and assumed sizes."""
    every = [F.col(f"{c}_{s}") for c in CUTOFFS for s in SIDES]
    missing = F.lit(False)
    wrong = F.lit(False)
    for q in every:
        missing |= q.isNull()
        wrong |= ~_sure((q["bid"] >= 0) & (q["bid"] <= q["ask"]) & (q["ask"] <= 1) & (q["ask"] > 0))
    reason = F.when(missing, "missing_causal_top").when(wrong, "invalid_causal_top").otherwise("")
    d = causal.withColumn("invalid_reason", reason).withColumn("snapshot_valid", F.col("invalid_reason") == "")
    ok = lambda c: F.when(F.col("snapshot_valid"), c)
    mid = lambda q: (F.col(f"{q}.bid") + F.col(f"{q}.ask")) / 2
    return d.withColumns(
        {"previous_mid_up": ok(mid("previous_up")), "mid_up": ok(mid("signal_up")), "mid_down": ok(mid("signal_down"))}
        | {f"{k}_{s}": ok(F.col(f"signal_{s}.{k}")) for s in SIDES for k in ("bid", "ask")}
        | {f"execution_size_{s}": ok(NOTIONAL / F.col(f"execution_{s}.ask")) for s in SIDES}
        | {"first_received": ok(F.least(*(q["t"] for q in every)))}
    )


def bounded(bids: list[Column], asks: list[Column], previous_mid: Column, execution_asks: list[Column]) -> Column:
    """Whether all numbers are there and finite, bids within [0, 1], asks within (0, 1], no side crossed, the
    previous mid within [0, 1] and execution asks within (0, 1]."""
    share = lambda c: c.between(0, 1)  # noqa: E731  false for NaN, which is above all numbers
    price = lambda c: (c > 0) & (c <= 1)
    parts = [*map(share, bids), *map(price, asks), *(b <= a for b, a in zip(bids, asks, strict=True)), share(previous_mid), *map(price, execution_asks)]
    out = F.lit(True)
    for p in parts:
        out &= _sure(p)
    return out


def executable_size(size: Column, ask: Column, target: float) -> Column:
    """The size where it is worth the target, else 0."""
    return F.when(_sure(size * ask >= target), size).otherwise(0.0)


def reason_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("markets"))
