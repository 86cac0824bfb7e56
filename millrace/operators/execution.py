"""Decision and fill engine: depth walk, side choice, gate cascade, settlement. No UDFs.

Everything is keyed by condition_id, so the walk's window, its sums and the join to the decisions
share one shuffle on that key. The probability table has as many rows as bins and is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


@dataclass(frozen=True)
class Rules:
    """Thresholds and costs of an evaluation."""

    edges: tuple[float, ...] = tuple(S.uniform_edges(10))
    minimum_support: int = 1
    minimum_persistence: float = 0.0
    minimum_ask: float = 0.01
    maximum_ask: float = 0.99
    minimum_net_edge: float = 0.0
    target: float = 10.0
    fee_rate: float = 0.07
    fee_exponent: float = 1.0
    fee_decimals: int = 5
    extra_cost: float = 0.01
    require_favorite: bool = False
    support_gate: bool = True
    persistence_gate: bool = True
    edge_gate: bool = True

    def but(self, **changes) -> Rules:
        return replace(self, **changes)


def walk(ladder: DataFrame, rules: Rules, fee_rate: Column | None = None) -> DataFrame:
    """Takes levels by rising price until the target is spent: one row per market, shares, cost and
    fee of each side. A level that is not a positive size at a price within (0, maximum_ask] is unused."""
    rate = F.lit(rules.fee_rate) if fee_rate is None else fee_rate
    usable = (F.col("price") > 0) & (F.col("price") <= rules.maximum_ask) & (F.col("size") > 0) & (F.col("size") < float("inf"))
    w = Window.partitionBy("condition_id", "side").orderBy("price").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("price") * F.col("size")).over(w), F.lit(0.0))
    d = ladder.where(usable).repartition("condition_id").withColumn("before", before)
    d = d.withColumn("taken", F.least(F.col("size"), F.greatest(rules.target - F.col("before"), F.lit(0.0)) / F.col("price")))
    fee = S.platform_fee(F.col("taken"), F.col("price"), rate, rules.fee_decimals, rules.fee_exponent)
    of = lambda side, c: F.sum(F.when(F.col("side") == side, c).otherwise(0.0))
    sums = [of(k, c).alias(f"{name}_{s}") for k, s in enumerate(("up", "down")) for name, c in (("shares", F.col("taken")), ("cost", F.col("taken") * F.col("price")), ("fee", fee))]
    return d.groupBy("condition_id").agg(*sums)


WALKED = [f"{name}_{s}" for s in ("up", "down") for name in ("shares", "cost", "fee")]


def walked_decisions(decisions: DataFrame, ladder: DataFrame, rules: Rules) -> DataFrame:
    """Decisions with what each side's ladder gives for the target: shares, cost and fee. Model, gates and extra cost
    do not matter yet, so several evaluations can share one walk."""
    if "fee_rate" in decisions.columns:  # a market's own rate is charged level by level
        rates = decisions.groupBy("condition_id").agg(F.max("fee_rate").alias("market_rate"))
        walked = walk(ladder.join(rates, "condition_id"), rules, F.coalesce("market_rate", F.lit(rules.fee_rate)))
    else:
        walked = walk(ladder, rules)
    return decisions.join(walked, "condition_id", "left")


def evaluate(decisions: DataFrame, ladder: DataFrame, model: DataFrame, rules: Rules, probability: Column | None = None, forced_side: Column | None = None, model_keys: tuple[str, ...] = ("bin",), show_gates: bool = False) -> DataFrame:
    """decisions with side, status and money of each market. model: (bin, probability_up, support,
    persistence), a row per bin, or per model_keys, such as fold and bin. The side follows from signal asks alone; unfilled markets earn 0.
    ladder: None where the decisions come from `walked_decisions`. show_gates adds each gate as a column, apart from the cascade."""
    r = rules
    d = decisions if ladder is None else walked_decisions(decisions, ladder, r)
    d = d.withColumn("bin", S.state_bin(F.col("mid_up"), list(r.edges)))
    d = d.join(F.broadcast(model), list(model_keys), "left")  # as many rows as bins (and folds)
    rate = F.coalesce("fee_rate", F.lit(r.fee_rate)) if "fee_rate" in decisions.columns else r.fee_rate
    p = F.col("probability_up") if probability is None else probability
    d = d.withColumns({"p_up": p, "p_down": 1 - p})
    edge = lambda s: S.net_edge(F.col(f"p_{s}"), F.col(f"ask_{s}"), rate, r.extra_cost, r.fee_exponent)
    low = F.lit(float("-inf"))
    d = d.withColumns({"edge_up": F.coalesce(S.missing(edge("up")), low), "edge_down": F.coalesce(S.missing(edge("down")), low)})
    if forced_side is None:
        d = d.withColumn("side", F.when(F.col("edge_down") > F.col("edge_up"), 1).otherwise(0))
        tie = (F.col("edge_up") == F.col("edge_down")) | F.coalesce(F.abs(S.missing(F.col("edge_up") - F.col("edge_down"))) <= 1e-12, F.lit(False))
    else:
        d = d.withColumn("side", forced_side)
        tie = F.lit(False)
    pick = lambda name: F.when(F.col("side") == 0, F.col(f"{name}_up")).otherwise(F.col(f"{name}_down"))
    d = d.withColumns({"tie": tie, "probability": pick("p"), "signal_ask": pick("ask"), "net_edge": pick("edge")} | {f"chosen_{n}": F.coalesce(pick(n), F.lit(0.0)) for n in ("shares", "cost", "fee")})
    no = lambda c: ~F.coalesce(c, F.lit(True))  # noqa: E731  a comparison with a missing number fails no gate
    cascade = F.when(~F.col("snapshot_valid"), 1)
    if r.support_gate:
        cascade = cascade.when(no(F.col("support") >= r.minimum_support), 2)
    cascade = cascade.when(no(F.col("signal_ask").between(r.minimum_ask, r.maximum_ask)), 3)
    if r.persistence_gate:
        cascade = cascade.when(no(F.col("persistence") >= r.minimum_persistence), 4)
    if r.edge_gate:
        cascade = cascade.when(no(F.col("net_edge") >= r.minimum_net_edge), 5)
    cascade = cascade.when(F.col("chosen_shares") <= 0, 6).when(F.col("tie"), 7)
    if r.require_favorite:
        cascade = cascade.when(F.col("side") != F.when(F.col("mid_down") > F.col("mid_up"), 1).otherwise(0), 8)
    d = d.withColumn("status", cascade.otherwise(0))
    filled = F.col("status") == 0
    money = lambda c: F.when(filled, c).otherwise(0.0)
    d = d.withColumns({"filled": filled, "fill_shares": money(F.col("chosen_shares")), "fill_cost": money(F.col("chosen_cost")), "platform_fee": money(F.col("chosen_fee"))})
    d = d.withColumns({"fill_vwap": S.ratio(F.col("chosen_cost"), F.col("chosen_shares")), "extra_cost": F.col("fill_shares") * r.extra_cost})
    d = d.withColumn("gross_pnl", money(F.coalesce(F.col("fill_shares") * S.settlement(F.col("side"), F.col("outcome_up")), F.lit(0.0)) - F.col("fill_cost")))
    d = d.withColumn("net_pnl", F.col("gross_pnl") - F.col("platform_fee") - F.col("extra_cost"))
    added = ["bin", "probability", "support", "persistence", "side", "signal_ask", "net_edge", "status", "filled", "fill_shares", "fill_cost", "fill_vwap", "platform_fee", "extra_cost", "gross_pnl", "net_pnl"]
    if show_gates:
        yes = lambda c: ~no(c)
        favorite = F.col("side") == F.when(F.col("mid_down") > F.col("mid_up"), 1).otherwise(0)
        shown = {
            "valid": F.col("snapshot_valid"), "support": yes(F.col("support") >= r.minimum_support) if r.support_gate else F.lit(True), "range": yes(F.col("signal_ask").between(r.minimum_ask, r.maximum_ask)), "persistence": yes(F.col("persistence") >= r.minimum_persistence) if r.persistence_gate else F.lit(True),
            "edge": yes(F.col("net_edge") >= r.minimum_net_edge) if r.edge_gate else F.lit(True), "executable": yes(F.col("chosen_shares") > 0), "decided": ~F.col("tie"), "favorite": yes(favorite) if r.require_favorite else F.lit(True),
        }
        d = d.withColumns({f"gate_{k}": c for k, c in shown.items()})
        added += [f"gate_{k}" for k in shown]
    return d.select(*[c for c in decisions.columns if c not in added and c not in WALKED], *added)
