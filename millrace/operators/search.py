"""Parameter search over grids of thresholds.

A market passes a cell if each of four quantities clears the cell's threshold, so a market's cells
are a box of the lattice. Markets are summed by their place on the lattice, and the cells' sums are
running sums along the four axes: the cost is markets + 4 x cells, not markets x cells.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import metrics

AXES = ("i0", "i1", "i2", "i3")


@dataclass(frozen=True)
class Grid:
    """Ascending thresholds of each axis."""

    minimum_ask: tuple[float, ...]
    maximum_ask: tuple[float, ...]
    minimum_persistence: tuple[float, ...]
    minimum_edge: tuple[float, ...]

    def axes(self) -> tuple[tuple[float, ...], ...]:
        return self.minimum_ask, self.maximum_ask, self.minimum_persistence, self.minimum_edge

    def cells(self, spark: SparkSession) -> DataFrame:
        """(cell_id, i0..i3, thresholds), those with minimum_ask < maximum_ask; numbered by index."""
        names = ("minimum_ask", "maximum_ask", "minimum_persistence", "minimum_edge")
        d = None
        for axis, name, values in zip(AXES, names, self.axes(), strict=True):
            one = spark.range(1).select(F.posexplode(F.array(*map(F.lit, values))).alias(axis, name))
            d = one if d is None else d.crossJoin(one)  # axes of a configured grid
        sizes = [len(v) for v in self.axes()]
        number = ((F.col("i0") * sizes[1] + F.col("i1")) * sizes[2] + F.col("i2")) * sizes[3] + F.col("i3")
        return d.where("minimum_ask < maximum_ask").withColumn("cell_id", number)

    def count(self) -> int:
        return sum(a < b for a, b in itertools.product(self.minimum_ask, self.maximum_ask)) * len(self.minimum_persistence) * len(self.minimum_edge)


ADDED = ("fills", "net_pnl", "gross_profit", "gross_loss", "stress_pnl", "half1_pnl", "half2_pnl")


def placed(evaluated: DataFrame, grid: Grid) -> DataFrame:
    """Markets that were filled with open gates, with their place: the last index that they clear on
    axes 0, 2 and 3, the first on axis 1."""
    least = lambda value, edges: sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    high = F.greatest(F.col("signal_ask"), F.col("fill_vwap"))
    first = sum((F.when(high > e, 1).otherwise(0) for e in grid.maximum_ask), F.lit(0))
    d = evaluated.where("filled").withColumns({"i0": least(F.col("signal_ask"), grid.minimum_ask), "i1": first, "i2": least(F.col("persistence"), grid.minimum_persistence), "i3": least(F.col("net_edge"), grid.minimum_edge)})
    return d.where((F.col("i0") >= 0) & (F.col("i1") < len(grid.maximum_ask)) & (F.col("i2") >= 0) & (F.col("i3") >= 0))


def grid_metrics(evaluated: DataFrame, grid: Grid, by: list[str]) -> DataFrame:
    """Sums of each cell. evaluated: open-gate results with stress_pnl (same trades, dearer) and
    first_half."""
    spark = evaluated.sparkSession
    pnl = F.col("net_pnl")
    at = placed(evaluated, grid).groupBy(*by, *AXES).agg(
        F.count(F.lit(1)).alias("fills"), F.sum("net_pnl").alias("net_pnl"), F.sum(F.greatest(pnl, F.lit(0.0))).alias("gross_profit"), F.sum(F.greatest(-pnl, F.lit(0.0))).alias("gross_loss"),
        F.sum("stress_pnl").alias("stress_pnl"), F.sum(F.when(F.col("first_half"), pnl).otherwise(0.0)).alias("half1_pnl"), F.sum(F.when(~F.col("first_half"), pnl).otherwise(0.0)).alias("half2_pnl"),
    )
    sizes = [len(v) for v in grid.axes()]
    spine = spark.range(1)
    for axis, n in zip(AXES, sizes, strict=True):
        spine = spine.crossJoin(spark.range(n).select(F.col("id").cast("int").alias(axis)))  # the lattice: configured sizes
    spine = spine.drop("id")
    if by:
        spine = evaluated.select(*by).distinct().crossJoin(F.broadcast(spine))
    d = spine.join(at, [*by, *AXES], "left").na.fill(0, list(ADDED))
    for axis in AXES:
        others = [x for x in AXES if x != axis]
        w = Window.partitionBy(*by, *others).orderBy(F.col(axis) if axis == "i1" else F.desc(axis)).rowsBetween(Window.unboundedPreceding, 0)
        d = d.select(*by, *AXES, *(F.sum(c).over(w).alias(c) for c in ADDED))
    cells = F.broadcast(grid.cells(spark))
    return d.join(cells, list(AXES)).withColumn("profit_factor", S.profit_factor(F.col("gross_profit"), F.col("gross_loss")))


def cell_paths(evaluated: DataFrame, grid: Grid, chosen: DataFrame, by: list[str]) -> DataFrame:
    """Maximum drawdown of chosen cells (a short list: it depends on order, so cells are walked)."""
    p = placed(evaluated, grid).select(*by, "market_start_s", "condition_id", "net_pnl", *(F.col(a).alias(f"m{a}") for a in AXES))
    c = F.broadcast(chosen.select("cell_id", *AXES))
    j = p.join(c, (F.col("i0") <= F.col("mi0")) & (F.col("i1") >= F.col("mi1")) & (F.col("i2") <= F.col("mi2")) & (F.col("i3") <= F.col("mi3")))
    r = metrics.running(j, "net_pnl", "market_start_s", "condition_id", [*by, "cell_id"])
    return r.groupBy(*by, "cell_id").agg(F.max("drawdown").alias("max_drawdown"))


def pool(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Cells over all folds: sums, profit factor of the sums, folds with a profit."""
    sums = [F.sum(c).alias(c) for c in ("fills", "net_pnl", "gross_profit", "gross_loss", "stress_pnl")]
    d = folds.groupBy(*keys).agg(*sums, F.count_if(F.col("net_pnl") > 0).alias("positive_folds"), F.count_if(F.col("stress_pnl") > 0).alias("positive_stress_folds"), F.count(F.lit(1)).alias("folds"))
    return d.withColumn("profit_factor", S.profit_factor(F.col("gross_profit"), F.col("gross_loss")))


def neighbours(cells: DataFrame, with_self: bool) -> DataFrame:
    """(cell i0..i3 as c0..c3, member's columns): each cell's neighbours one step away on one axis, as
    an equi-join on shifted indices; missing ones have no row."""
    steps = [(0, 0, 0, 0)] * with_self + [tuple(s if k == a else 0 for k in range(4)) for a in range(4) for s in (-1, 1)]
    moved = F.array(*(F.struct(*(F.lit(v).alias(f"d{k}") for k, v in enumerate(s))) for s in steps))
    own = cells.select(*(F.col(a).alias(f"c{k}") for k, a in enumerate(AXES)), F.explode(moved).alias("d"))
    own = own.select("c0", "c1", "c2", "c3", *((F.col(f"c{k}") + F.col(f"d.d{k}")).cast("int").alias(a) for k, a in enumerate(AXES)))
    return own.join(cells, list(AXES))


def neighbour_floor(pooled: DataFrame) -> DataFrame:
    """Each cell with the least profit and the fewest positive folds among its neighbours; a cell without
    any has no floor (infinity) and the full number of folds."""
    f = neighbours(pooled, False).groupBy("c0", "c1", "c2", "c3").agg(F.min("net_pnl").alias("floor_pnl"), F.min("positive_folds").alias("floor_folds"))
    j = pooled.join(f, [F.col(a) == F.col(f"c{k}") for k, a in enumerate(AXES)], "left")
    return j.select(*pooled.columns, F.coalesce("floor_pnl", F.lit(float("inf"))).alias("floor_pnl"), F.coalesce("floor_folds", "folds").alias("floor_folds"))


def plateau(pooled: DataFrame) -> DataFrame:
    """Statistics over each cell and its neighbours."""
    m = neighbours(pooled, True).groupBy("c0", "c1", "c2", "c3").agg(
        F.count(F.lit(1)).alias("members"), F.median("net_pnl").alias("median_pnl"), F.median("stress_pnl").alias("median_stress_pnl"), F.median("positive_folds").alias("median_positive_folds"),
        F.avg((F.col("net_pnl") > 0).cast("double")).alias("profitable_fraction"), F.avg((F.col("stress_pnl") > 0).cast("double")).alias("stress_profitable_fraction"), F.min("net_pnl").alias("minimum_pnl"), F.max("net_pnl").alias("maximum_pnl"),
    )
    return pooled.join(m, [F.col(a) == F.col(f"c{k}") for k, a in enumerate(AXES)]).drop("c0", "c1", "c2", "c3")


def gates(df: DataFrame, **rules) -> DataFrame:
    """Adds each gate as a boolean, how many passed, and eligible if all did."""
    d = df.withColumns({f"gate_{k}": F.coalesce(c, F.lit(False)) for k, c in rules.items()})
    passed = sum((F.col(f"gate_{k}").cast("int") for k in rules), F.lit(0))
    return d.withColumns({"passed": passed, "eligible": passed == len(rules)})


def select_cells(gated: DataFrame, order: list, top: int, near: int, n_gates: int) -> DataFrame:
    """The top eligible cells, and beside them the nearest misses (those with most gates passed). Cells
    are a configured grid; they are ranked in one pass, eligible ones apart."""
    w = Window.partitionBy("eligible")
    d = gated.withColumn("__near", F.col("passed") == F.max("passed").over(w))
    d = d.withColumn("__r", F.row_number().over(w.orderBy(F.desc("__near"), *order)))
    d = d.withColumn("kind", F.when(F.col("eligible"), "eligible").otherwise("near_miss"))
    return d.where(F.when(F.col("eligible"), F.col("__r") <= top).otherwise(F.col("__near") & (F.col("__r") <= near))).drop("__near", "__r")
