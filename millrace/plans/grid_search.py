"""Walk-forward search: fit per fold, evaluate once with open gates, sum the lattice, pool, select."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import execution, models, search, splits
from ..operators.execution import Rules
from ..operators.search import Grid
from ..sources import views
from ..sources.scratch import kept
from . import invariants

GRID = Grid(minimum_ask=(0.01, 0.02, 0.05, 0.1), maximum_ask=(0.05, 0.1, 0.2, 0.3, 0.5, 0.95), minimum_persistence=(0.0, 0.05, 0.1, 0.2, 0.4), minimum_edge=(-0.05, 0.0, 0.02, 0.05, 0.1))
OPEN = Rules(minimum_support=0, minimum_persistence=0.0, minimum_ask=0.0, maximum_ask=1.0, minimum_net_edge=float("-inf"))


class FoldError(ValueError):
    """Folds that look ahead or leave gaps."""


@dataclass(frozen=True)
class Fold:
    """Half-open windows in epoch seconds."""

    fold_id: int
    train_start_s: int
    train_end_s: int
    validation_start_s: int
    validation_end_s: int


def check_folds(folds: list[Fold], holdout_start_s: int | None = None) -> list[Fold]:
    """Training starts together and ends where validation starts; validations touch; the holdout is later."""
    for a, b in zip(folds, folds[1:], strict=False):
        if b.validation_start_s != a.validation_end_s or b.train_start_s != a.train_start_s:
            raise FoldError("validation windows must touch and training must expand")
    for f in folds:
        if not f.train_start_s < f.train_end_s <= f.validation_start_s < f.validation_end_s:
            raise FoldError("a fold must train before it validates")
    if holdout_start_s is not None and folds and folds[-1].validation_end_s > holdout_start_s:
        raise FoldError("the last fold reaches into the holdout")
    return folds


#: Folds over the sample orders: four quarters after an expanding start.
YEAR = 31_536_000
FOLDS = check_folds([Fold(k, 694_224_000, 694_224_000 + (3 + k) * YEAR, 694_224_000 + (3 + k) * YEAR, 694_224_000 + (4 + k) * YEAR) for k in range(3)])


def fold_results(spark: SparkSession, sf_dir: str, folds: list[Fold] | None = None, extra: float = 0.01) -> DataFrame:
    """Open-gate results of each fold's validation markets, with stress_pnl and first_half. Books are
    walked once for all folds; each fold has its own model, fitted on its training rows. The results are kept, and
    fail as they are written if gates and fills differ or stress (extra cost a share) improves a trade."""
    folds = folds or FOLDS
    ladder = views.depth(spark, sf_dir)
    decisions = kept(execution.walked_decisions(views.markets(spark, sf_dir).join(views.tops(ladder), "condition_id"), ladder, OPEN))
    windows = spark.createDataFrame([(f.fold_id, f.train_start_s, f.train_end_s) for f in folds], "fold_id int, train_start_s long, train_end_s long")
    model = models.lookup_model(splits.folds(decisions, windows, "market_start_s", "train"), list(OPEN.edges), by=["fold_id"])
    rows = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(f.fold_id).alias("fold_id"), F.lit(f.validation_start_s).alias("validation_start_s"), F.lit(f.validation_end_s).alias("validation_end_s")) for f in folds))).alias("f")).select("f.*")
    markets = splits.folds(decisions, rows, "market_start_s")
    d = execution.evaluate(markets, None, model, OPEN, model_keys=("fold_id", "bin"), show_gates=True)
    d = d.withColumn("stress_pnl", F.when(F.col("filled"), F.col("net_pnl") - extra * F.col("fill_shares")).otherwise(0.0))
    d = invariants.upheld(d, "fold results", gates=invariants.all_gates(), stress=invariants.same_under_stress())
    d = d.drop(*(c for c in d.columns if c.startswith("gate_")))
    return splits.first_half(d, markets, ["fold_id"], ["market_start_s", "condition_id"])


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grid_metrics(fold_results(spark, sf_dir), GRID, ["fold_id"])


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per cell; kept, since neighbours join it to itself."""
    return kept(search.pool(fold_metrics(spark, sf_dir), ["cell_id", *search.AXES, "minimum_ask", "maximum_ask", "minimum_persistence", "minimum_edge"]))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = search.plateau(search.neighbour_floor(pooled(spark, sf_dir)))
    return search.gates(p, fills=F.col("fills") >= 30, profit=F.col("net_pnl") > 0, factor=F.col("profit_factor") > 1.0, stress=F.col("stress_pnl") > 0, folds=F.col("positive_folds") >= 2, plateau=F.col("median_pnl") > 0, fraction=F.col("profitable_fraction") >= 0.6, floor=F.col("floor_folds") >= 1)


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("passed"), F.desc(F.round("median_pnl", 6)), F.desc(F.round("net_pnl", 6)), F.asc("cell_id")]
    return search.select_cells(gated(spark, sf_dir), order, top=25, near=10, n_gates=8)


@dataclass(frozen=True)
class WalkForwardGates:
    """Limits of a walk-forward selection."""

    fold_fills: int = 5
    fold_fraction: float = 0.001
    pooled_fills: int = 20
    pooled_fraction: float = 0.001
    pooled_most: float = 0.9
    profit_factor: float = 1.0
    positive_folds: int = 2
    positive_stress_folds: int = 1
    fold_drawdown: float = 250.0
    neighbour_fraction: float = 0.3
    neighbour_folds: int = 1


def walkforward_gated(folds: DataFrame, markets: DataFrame, cells: DataFrame, g: WalkForwardGates) -> DataFrame:
    """Each cell with what the folds gave it and its twelve gates. folds: (fold_id, cell_id, sums, max_drawdown); markets:
    (fold_id, markets), a row a fold; cells: (cell_id, axes)."""
    f = folds.join(F.broadcast(markets), "fold_id")
    exposed = F.col("fills") >= F.greatest(F.lit(g.fold_fills), F.ceil(F.col("markets") * g.fold_fraction))
    per = f.groupBy("cell_id").agg(F.every(exposed).alias("exposed"), F.every(F.col("max_drawdown") <= g.fold_drawdown).alias("bounded"), F.min("net_pnl").alias("minimum_fold_pnl"), F.sum("markets").alias("markets"))
    p = kept(search.pool(folds, ["cell_id"]).join(per, "cell_id").join(F.broadcast(cells), "cell_id"))
    p = search.neighbour_floor(p).withColumn("fill_fraction", F.col("fills") / F.col("markets"))
    return search.gates(
        p, fold_exposure=F.col("exposed"), least_exposure=F.col("fills") >= F.greatest(F.lit(g.pooled_fills), F.ceil(F.col("markets") * g.pooled_fraction)), most_exposure=F.col("fills") <= F.floor(F.col("markets") * g.pooled_most), profit=F.col("net_pnl") > 0, factor=F.col("profit_factor") >= g.profit_factor,
        folds=F.col("positive_folds") >= g.positive_folds, stress=F.col("stress_pnl") > 0, stress_folds=F.col("positive_stress_folds") >= g.positive_stress_folds, drawdown=F.col("bounded"), floor=F.col("floor_pnl") > 0, floor_fraction=F.col("floor_pnl") >= g.neighbour_fraction * F.col("net_pnl"), floor_folds=F.col("floor_folds") >= g.neighbour_folds,
    )


def walkforward_selected(gated: DataFrame, top: int, near: int) -> DataFrame:
    """The best eligible cells, in order of folds with a profit, worst fold, stress and profit, fewest fills; and the nearest misses, in order
    of gates passed first. kind and place."""
    r = lambda c: F.round(c, 6)
    best = [F.desc("positive_folds"), F.desc(r("minimum_fold_pnl")), F.desc(r("stress_pnl")), F.desc(r("net_pnl")), F.asc(r("fill_fraction")), F.asc("cell_id")]
    close = [F.desc("passed"), F.desc("positive_stress_folds"), F.desc("positive_folds"), F.desc(r("stress_pnl")), F.desc(r("net_pnl")), F.asc(r("fill_fraction")), F.asc("cell_id")]
    w = Window.partitionBy("eligible")  # cells of a configured grid
    d = gated.withColumn("place", F.when(F.col("eligible"), F.row_number().over(w.orderBy(*best))).otherwise(F.row_number().over(w.orderBy(*close))))
    return d.withColumn("kind", F.when(F.col("eligible"), "eligible").otherwise("near_miss")).where(F.col("place") <= F.when(F.col("eligible"), top).otherwise(near))
