"""Queries over larger grids: five axes with thresholds from training quantiles, the uniform grid, exact quantiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import lattice, metrics, quantiles, search
from .operators.lattice import Axis, Lattice
from .plans import backtest, grid_search, invariants
from .queries import _GRID, DAY, ORACLE_SQL, PIECES, _eval, query, sql
from .sources import views
from .sources.scratch import kept

#: The grid of five axes and the uniform one of 37,638 cells: fixed values.
SHARES = (0.0, 0.25, 0.5, 0.75, 0.9)
FIVE = {"minimum_ask": (0.20, 0.35, 0.45, 0.50, 0.55, 0.65, 0.80), "maximum_ask": (0.50, 0.55, 0.60, 0.70, 0.85, 0.95, 0.99), "minimum_edge": (0.00, 0.01, 0.02, 0.03, 0.05, 0.08), "minimum_support": (1, 5, 10, 20, 50, 100)}
UNIFORM = {"minimum_ask": [k / 100 for k in range(20, 85, 5)], "maximum_ask": [k / 100 for k in range(50, 100, 5)], "minimum_edge": [k / 100 for k in range(9)], "minimum_persistence": [k / 100 for k in range(10, 92, 2)]}
#: Trades of a quarter are walked together.
BUCKET = 91 * DAY


def ask_axes(values: dict) -> list[Axis]:
    return [Axis("minimum_ask", "signal_ask", tuple(values["minimum_ask"])), Axis("maximum_ask", "high_ask", tuple(values["maximum_ask"]), most=True)]


def five(persistence: list[float]) -> Lattice:
    return Lattice((*ask_axes(FIVE), Axis("minimum_edge", "net_edge", FIVE["minimum_edge"]), Axis("minimum_persistence", "persistence", tuple(persistence)), Axis("minimum_support", "support", FIVE["minimum_support"])), ("minimum_ask", "maximum_ask"))


def uniform() -> Lattice:
    return Lattice((*ask_axes(UNIFORM), Axis("minimum_edge", "net_edge", tuple(UNIFORM["minimum_edge"])), Axis("minimum_persistence", "persistence", tuple(UNIFORM["minimum_persistence"]))), ("minimum_ask", "maximum_ask"))


def _open(spark, sf_dir):
    """Every market with all gates open, once: its place on a grid follows from these columns."""
    d = backtest.evaluated(spark, sf_dir, grid_search.OPEN)
    d = d.withColumns({"high_ask": F.greatest("signal_ask", "fill_vwap"), "stress_pnl": F.col("net_pnl") - 0.01 * F.col("fill_shares")})
    return kept(d.select("split", "condition_id", "market_start_s", "snapshot_valid", "filled", "signal_ask", "high_ask", "persistence", "support", "net_edge", "net_pnl", "stress_pnl"))


VALUES = {"net_pnl": F.col, "gross_profit": lambda _: F.greatest(F.col("net_pnl"), F.lit(0.0)), "gross_loss": lambda _: F.greatest(-F.col("net_pnl"), F.lit(0.0)), "stress_pnl": F.col}


def _metrics(d, grid: Lattice, splits: tuple[str, ...]):
    spark = d.sparkSession
    keys = spark.createDataFrame([(s,) for s in splits], "split string")
    trades = d.where("filled").join(F.broadcast(keys), "split")
    return lattice.metrics(trades, keys, grid, {n: f(n) for n, f in VALUES.items()}, BUCKET)


PIECES["open"] = (("model",), _eval("open0", "split", "model", grid_search.OPEN).strip() + ", open AS (SELECT *, greatest(signal_ask, fill_vwap) AS high_ask, net_pnl - CAST(0.01 AS DOUBLE) * fill_shares AS stress_pnl FROM open0)")


def _axis(name: str, values) -> str:
    return f"(SELECT unnest([{', '.join(f'CAST({float(v)!r} AS DOUBLE)' for v in values)}]) AS v, unnest(range({len(values)})) AS i) AS {name}"


def _cells(axes: dict, quantile_axis: str | None = None) -> str:
    """SQL of the cells of a grid: the last axis varies first; a quantile axis comes from the table `thresholds`."""
    number = "0"
    for name, values in axes.items():
        number = f"({number}) * {len(values)} + {name}.i"
    source = ", ".join("thresholds AS minimum_persistence" if name == quantile_axis else _axis(name, values) for name, values in axes.items())
    return f"cells5 AS (SELECT {number} AS cell_id, {', '.join(f'{n}.v AS {n}' for n in axes)} FROM {source} WHERE minimum_ask.v < maximum_ask.v)"


_QUANTILES = "thresholds AS (SELECT unnest(q) AS v, unnest(range(len(q))) AS i FROM (SELECT quantile_cont(persistence, [" + ", ".join(map(str, SHARES)) + "]) AS q FROM open WHERE split = 'train' AND snapshot_valid AND persistence IS NOT NULL))"
_FIVE_AXES = {"minimum_ask": FIVE["minimum_ask"], "maximum_ask": FIVE["maximum_ask"], "minimum_edge": FIVE["minimum_edge"], "minimum_persistence": SHARES, "minimum_support": FIVE["minimum_support"]}
PIECES["five"] = (("open",), f"{_QUANTILES}, {_cells(_FIVE_AXES, 'minimum_persistence')}")
PIECES["uniform"] = (("open",), _cells(UNIFORM))


def _grid_sql(splits: tuple[str, ...], support: bool) -> str:
    ok = "x.signal_ask >= c.minimum_ask AND x.high_ask <= c.maximum_ask AND x.net_edge >= c.minimum_edge AND x.persistence >= c.minimum_persistence" + (" AND x.support >= c.minimum_support" if support else "")
    names = ", ".join(f"'{s}'" for s in splits)
    return f"""SELECT s.split, c.cell_id, coalesce(g.fills, 0) AS fills, coalesce(g.net_pnl, 0) AS net_pnl, coalesce(g.gross_profit, 0) AS gross_profit, coalesce(g.gross_loss, 0) AS gross_loss, coalesce(g.stress_pnl, 0) AS stress_pnl, coalesce(g.max_drawdown, 0) AS max_drawdown
      FROM cells5 c CROSS JOIN (SELECT unnest([{names}]) AS split) s LEFT JOIN (SELECT split, cell_id, count(*) AS fills, sum(net_pnl) AS net_pnl, sum(greatest(net_pnl, 0)) AS gross_profit, sum(greatest(-net_pnl, 0)) AS gross_loss, sum(stress_pnl) AS stress_pnl, max(greatest(peak, 0) - cum) AS max_drawdown
        FROM (SELECT *, max(cum) OVER (PARTITION BY split, cell_id ORDER BY market_start_s, condition_id) AS peak FROM (SELECT x.split, c.cell_id, x.net_pnl, x.stress_pnl, x.market_start_s, x.condition_id, sum(x.net_pnl) OVER (PARTITION BY x.split, c.cell_id ORDER BY x.market_start_s, x.condition_id) AS cum FROM open x JOIN cells5 c ON {ok} WHERE x.filled AND x.split IN ({names}))) GROUP BY 1, 2) g ON g.split = s.split AND g.cell_id = c.cell_id"""


_OUT = ["split", "cell_id", "fills", "net_pnl", "gross_profit", "gross_loss", "stress_pnl", "max_drawdown"]
_DOUBLES = "net_pnl gross_profit gross_loss stress_pnl max_drawdown"


@query("q_grid_5d", sql(_grid_sql(("validation", "test"), True), "five", doubles=_DOUBLES))
def grid_5d(spark, sf_dir):
    """7,020 cells of five axes, persistence thresholds from training quantiles, with drawdowns."""
    d = _open(spark, sf_dir)
    edges = quantiles.value_at(d.where("split = 'train' AND snapshot_valid"), "persistence", list(SHARES))
    return _metrics(d, five(edges), ("validation", "test")).select(*_OUT)


@query("q_grid_uniform", sql(_grid_sql(("test",), False), "uniform", doubles=_DOUBLES))
def grid_uniform(spark, sf_dir):
    """The uniform grid of 37,638 cells."""
    return _metrics(_open(spark, sf_dir), uniform(), ("test",)).select(*_OUT)


# Drawdowns beside the sums of the walk-forward grid.
_FALL = """SELECT g.fold_id, g.cell_id, g.fills, g.net_pnl, g.gross_profit, g.gross_loss, g.stress_pnl, g.half1_pnl, g.half2_pnl, coalesce(d.max_drawdown, 0) AS max_drawdown FROM grid g LEFT JOIN (SELECT fold_id, cell_id, max(greatest(peak, 0) - cum) AS max_drawdown
  FROM (SELECT *, max(cum) OVER (PARTITION BY fold_id, cell_id ORDER BY market_start_s, condition_id) AS peak FROM (SELECT x.fold_id, c.cell_id, x.market_start_s, x.condition_id, sum(x.net_pnl) OVER (PARTITION BY x.fold_id, c.cell_id ORDER BY x.market_start_s, x.condition_id) AS cum FROM folds x
    JOIN cells c ON x.signal_ask >= c.minimum_ask AND x.signal_ask <= c.maximum_ask AND x.fill_vwap <= c.maximum_ask AND x.persistence >= c.minimum_persistence AND x.net_edge >= c.minimum_edge WHERE x.filled)) GROUP BY 1, 2) d USING (fold_id, cell_id)"""


def fold_lattice() -> Lattice:
    """The walk-forward grid as a lattice: equal numbers of cells."""
    lo, hi, persistence, edge = _GRID.axes()
    return Lattice((Axis("minimum_ask", "signal_ask", lo), Axis("maximum_ask", "high_ask", hi, most=True), Axis("minimum_persistence", "persistence", persistence), Axis("minimum_edge", "net_edge", edge)), ("minimum_ask", "maximum_ask"))


@query("q_grid_metrics", sql(_FALL, "grid", doubles="net_pnl gross_profit gross_loss stress_pnl half1_pnl half2_pnl max_drawdown"))
def grid_metrics(spark, sf_dir):
    """All measures of each cell and fold of the walk-forward grid."""
    d = kept(grid_search.fold_results(spark, sf_dir).withColumn("high_ask", F.greatest("signal_ask", "fill_vwap")))
    folds = spark.createDataFrame([(f.fold_id,) for f in grid_search.FOLDS], "fold_id int")
    half = lambda first: F.when(F.col("first_half") == first, F.col("net_pnl")).otherwise(0.0)
    values = {n: f(n) for n, f in VALUES.items()} | {"half1_pnl": half(True), "half2_pnl": half(False)}
    out = lattice.metrics(d.where("filled"), folds, fold_lattice(), values, BUCKET)
    return out.select("fold_id", "cell_id", "fills", *values, "max_drawdown")


@query("q_quantiles", ORACLE_SQL["q_quantiles"])
def exact_quantiles(spark, sf_dir):
    wanted = {"p10": ("usdc_size", 0.1), "p50": ("usdc_size", 0.5), "p90": ("usdc_size", 0.9), "median_price": ("price", 0.5)}
    return quantiles.quantiles(views.activity(spark, sf_dir), ["activity_type"], wanted)


_BEST = """best AS (SELECT fold_id, cell_id, fills, net_pnl, minimum_ask, maximum_ask, minimum_persistence, minimum_edge FROM (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY round(net_pnl, 6) DESC, cell_id) AS r FROM grid) WHERE r = 1)"""
PIECES["best"] = (("grid",), _BEST)


@query("q_replay_equals", sql("""SELECT b.fold_id, b.cell_id, b.fills, b.net_pnl, coalesce(r.fills, 0) AS replay_fills, coalesce(r.net_pnl, 0) AS replay_pnl, b.fills = coalesce(r.fills, 0) AND abs(b.net_pnl - coalesce(r.net_pnl, 0)) <= 1e-9 AS agrees FROM best b LEFT JOIN (SELECT fold_id, count(*) AS fills, arg_max(cum, (market_start_s, condition_id)) AS net_pnl
  FROM (SELECT x.fold_id, x.market_start_s, x.condition_id, sum(x.net_pnl) OVER (PARTITION BY x.fold_id ORDER BY x.market_start_s, x.condition_id) AS cum FROM folds x JOIN best c ON c.fold_id = x.fold_id AND x.signal_ask >= c.minimum_ask AND x.signal_ask <= c.maximum_ask AND x.fill_vwap <= c.maximum_ask AND x.persistence >= c.minimum_persistence AND x.net_edge >= c.minimum_edge WHERE x.filled) GROUP BY 1) r USING (fold_id)""", "best", doubles="net_pnl replay_pnl"))
def replay_equals(spark, sf_dir):
    """The best cell of each fold, replayed trade by trade in strict order, against what the grid gave it."""
    d = kept(grid_search.fold_results(spark, sf_dir))
    grid = search.grid_metrics(d, _GRID, ["fold_id"])
    order = [F.desc(F.round("net_pnl", 6)), F.asc("cell_id")]
    best = kept(grid.withColumn("r", F.row_number().over(Window.partitionBy("fold_id").orderBy(*order))).where("r = 1").select("fold_id", "cell_id", "fills", "net_pnl", "minimum_ask", "maximum_ask", "minimum_persistence", "minimum_edge"))
    cell = F.broadcast(best.drop("fills", "net_pnl"))  # a row a fold
    trades = d.where("filled").join(cell, "fold_id").where("signal_ask >= minimum_ask AND greatest(signal_ask, fill_vwap) <= maximum_ask AND persistence >= minimum_persistence AND net_edge >= minimum_edge")
    trades = invariants.strict_order(trades, ["fold_id", "market_start_s", "condition_id"])
    path = metrics.running(trades, "net_pnl", "market_start_s", "condition_id", ["fold_id"])
    replay = path.groupBy("fold_id").agg(F.count(F.lit(1)).alias("replay_fills"), F.max_by("cum", F.struct("market_start_s", "condition_id")).alias("replay_pnl"))
    both = best.join(replay, "fold_id", "left").na.fill(0, ["replay_fills", "replay_pnl"])
    agrees = (F.col("fills") == F.col("replay_fills")) & (F.abs(F.col("net_pnl") - F.col("replay_pnl")) <= 1e-9)
    return both.select("fold_id", "cell_id", "fills", "net_pnl", "replay_fills", "replay_pnl", agrees.alias("agrees"))


G = grid_search.WalkForwardGates()
PIECES["gates12"] = (("grid", "floor"), f"""wg AS ({_FALL}), wm AS (SELECT fold_id, count(*) AS markets FROM folds GROUP BY 1),
wp AS (SELECT cell_id, bool_and(fills >= greatest({G.fold_fills}, ceil(markets * CAST({G.fold_fraction} AS DOUBLE)))) AS exposed, bool_and(max_drawdown <= {G.fold_drawdown}) AS bounded, min(net_pnl) AS minimum_fold_pnl, CAST(sum(markets) AS BIGINT) AS markets FROM wg JOIN wm USING (fold_id) GROUP BY 1),
wx AS (SELECT f.*, exposed, bounded, minimum_fold_pnl, markets, f.fills / markets AS fill_fraction FROM floors f JOIN wp USING (cell_id)),
wq AS (SELECT *, CAST(exposed AS INT) + CAST(fills >= greatest({G.pooled_fills}, ceil(markets * CAST({G.pooled_fraction} AS DOUBLE))) AS INT) + CAST(fills <= floor(markets * CAST({G.pooled_most} AS DOUBLE)) AS INT) + CAST(net_pnl > 0 AS INT) + CAST(profit_factor >= {G.profit_factor} AS INT) + CAST(positive_folds >= {G.positive_folds} AS INT)
  + CAST(stress_pnl > 0 AS INT) + CAST(positive_stress_folds >= {G.positive_stress_folds} AS INT) + CAST(bounded AS INT) + CAST(floor_pnl > 0 AS INT) + CAST(floor_pnl >= CAST({G.neighbour_fraction} AS DOUBLE) * net_pnl AS INT) + CAST(floor_folds >= {G.neighbour_folds} AS INT) AS passed FROM wx)""")


@query("q_walkforward_gates", sql("""SELECT cell_id, kind, CAST(place AS INT) AS place, CAST(passed AS INT) AS passed, positive_folds, positive_stress_folds, minimum_fold_pnl, stress_pnl, net_pnl, fill_fraction FROM (
  SELECT *, 'eligible' AS kind, row_number() OVER (ORDER BY positive_folds DESC, round(minimum_fold_pnl, 6) DESC, round(stress_pnl, 6) DESC, round(net_pnl, 6) DESC, round(fill_fraction, 6), cell_id) AS place FROM wq WHERE passed = 12
  UNION ALL SELECT *, 'near_miss', row_number() OVER (ORDER BY passed DESC, positive_stress_folds DESC, positive_folds DESC, round(stress_pnl, 6) DESC, round(net_pnl, 6) DESC, round(fill_fraction, 6), cell_id) FROM wq WHERE passed < 12) WHERE place <= 20""", "gates12", doubles="minimum_fold_pnl stress_pnl net_pnl fill_fraction"))
def walkforward_gates(spark, sf_dir):
    """Twelve gates over pooled folds, and the selection in its order, beside the nearest misses in theirs."""
    d = kept(grid_search.fold_results(spark, sf_dir).withColumn("high_ask", F.greatest("signal_ask", "fill_vwap")))
    folds = spark.createDataFrame([(f.fold_id,) for f in grid_search.FOLDS], "fold_id int")
    m = kept(lattice.metrics(d.where("filled"), folds, fold_lattice(), {n: f(n) for n, f in VALUES.items()}, BUCKET))
    markets = d.groupBy("fold_id").agg(F.count(F.lit(1)).alias("markets"))
    gated = grid_search.walkforward_gated(m, markets, _GRID.cells(spark).select("cell_id", *search.AXES), G)
    return grid_search.walkforward_selected(gated, 20, 20).select("cell_id", "kind", "place", "passed", "positive_folds", "positive_stress_folds", "minimum_fold_pnl", "stress_pnl", "net_pnl", "fill_fraction")
