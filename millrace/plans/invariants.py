"""Checks between results: strict order, equal replays, the same trades under stress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import kept


class InvariantError(ValueError):
    """Two results that must agree do not."""


def upheld(df: DataFrame, what: str, **rules: Column) -> DataFrame:
    """df, computed once and kept. Rows that break a rule (a condition that isn't true) are counted while it is written, so
    the check costs no scan of its own; any such row is an InvariantError."""
    seen = Observation()
    out = kept(df.observe(seen, *(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items())))
    broken = {n: k for n, k in seen.get.items() if k}
    if broken:
        raise InvariantError(f"{what}: rows that break {broken}")
    return out


def all_gates() -> Column:
    """All displayed gates together are the fills."""
    names = ("valid", "support", "range", "persistence", "edge", "executable", "decided", "favorite")
    together = F.lit(True)
    for n in names:
        together &= F.col(f"gate_{n}")
    return together.eqNullSafe(F.col("filled"))


def same_under_stress(tolerance: float = 1e-12) -> Column:
    """Stress makes no trade better and leaves what isn't a trade at 0."""
    return F.when(F.col("filled"), F.col("stress_pnl") <= F.col("net_pnl") + tolerance).otherwise(F.col("stress_pnl") == 0)


def strict_order(trades: DataFrame, keys: list[str]) -> DataFrame:
    """trades, after a check that no two rows have equal keys and none is missing, so that their order is total."""
    bad = trades.groupBy(*keys).count().where((F.col("count") > 1) | F.greatest(*(F.col(k).isNull().cast("int") for k in keys), F.lit(0)).cast("boolean")).take(3)
    if bad:
        raise InvariantError(f"order is not strict at {[tuple(r) for r in bad]}")
    return trades


def disagreements(a: DataFrame, b: DataFrame, keys: list[str], counts: list[str], sums: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys where two results differ: counts must be equal, sums within tolerance, rows on both sides."""
    l = a.select(*keys, *(F.col(c).alias(f"a_{c}") for c in counts + sums), F.lit(True).alias("in_a"))
    r = b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in counts + sums), F.lit(True).alias("in_b"))
    same = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    for c in counts:
        same &= F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    for c in sums:
        same &= F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance, F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull())
    return l.join(r, keys, "full_outer").where(~same)


def require_replay(replay: DataFrame, grid: DataFrame, keys: list[str]) -> None:
    """A replay of a cell has the fills and the profit that the grid gave it."""
    bad = disagreements(replay, grid, keys, ["fills"], ["net_pnl"]).take(3)
    if bad:
        raise InvariantError(f"replay differs from the grid: {[r.asDict() for r in bad]}")


def require_same_trades(primary: DataFrame, stress: DataFrame, keys: list[str]) -> None:
    """Stress changes what a trade earns, never which trades there are."""
    bad = disagreements(primary.where("filled"), stress.where("filled"), keys, ["side"], ["fill_shares"]).take(3)
    if bad:
        raise InvariantError(f"stress changes trades: {[r.asDict() for r in bad]}")
