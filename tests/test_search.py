"""Grids of any axes and exact quantiles against direct versions."""

import math
import random

import numpy as np
import pytest
from millrace.operators import lattice, quantiles
from millrace.operators.lattice import Axis, Lattice
from pyspark.sql import functions as F

GRID = Lattice((Axis("lo", "ask", (0.1, 0.3, 0.5)), Axis("hi", "high", (0.2, 0.5, 0.9), most=True), Axis("edge", "edge", (0.0, 0.1)), Axis("support", "support", (1, 5)), Axis("steady", "steady", (0.2,))), ("lo", "hi"))


def trades(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        ask = r.choice([None, 0.1, 0.3, r.random()])
        out.append((r.choice([1, 2]), k, r.randrange(0, 40) * 5, ask, None if ask is None else min(1.0, ask + r.random() / 5), r.choice([0.0, 0.1, r.random() - 0.5]), float(r.randrange(8)), r.choice([0.2, 0.1, float("nan"), 0.7]), r.gauss(0, 1)))
    return out


def direct(rows, grid):
    out = {}
    size = [len(a.values) for a in grid.axes]
    for flat in range(math.prod(size)):
        at = np.unravel_index(flat, size)
        lo, hi, edge, support, steady = (a.values[i] for a, i in zip(grid.axes, at, strict=True))
        if not lo < hi:
            continue
        for fold in (1, 2):
            own = sorted((r for r in rows if r[0] == fold and r[3] is not None and r[3] >= lo and r[4] <= hi and r[5] >= edge and r[6] >= support and r[7] >= steady), key=lambda r: (r[2], r[1]))
            cum = peak = fall = 0.0
            for r in own:
                cum += r[8]
                peak = max(peak, cum)
                fall = max(fall, peak - cum)
            out[fold, flat] = len(own), round(cum, 9), round(fall, 9)
    return out


@pytest.mark.parametrize("bucket", [1, 30, 10_000])
def test_sums_and_drawdowns_of_every_cell(spark, bucket):
    rows = trades(bucket, 400)
    df = spark.createDataFrame(rows, "fold int, condition_id long, market_start_s long, ask double, high double, edge double, support double, steady double, net_pnl double").repartition(3)
    folds = spark.createDataFrame([(1,), (2,)], "fold int")
    got = lattice.metrics(df, folds, GRID, {"net_pnl": F.col("net_pnl")}, bucket).collect()
    assert {(r["fold"], r["cell_id"]): (r["fills"], round(r["net_pnl"], 9) + 0.0, round(r["max_drawdown"], 9)) for r in got} == direct(rows, GRID)
    first = next(r for r in got if r["cell_id"] == 0)
    assert (first["lo"], first["hi"], first["edge"]) == (0.1, 0.2, 0.0)


def test_a_grid_without_trades(spark):
    df = spark.createDataFrame([], "fold int, condition_id long, market_start_s long, ask double, high double, edge double, support double, steady double, net_pnl double")
    got = lattice.metrics(df, spark.createDataFrame([(1,)], "fold int"), GRID, {"net_pnl": F.col("net_pnl")}, 10).collect()
    assert len(got) == len(GRID.indices()) and all((r["fills"], r["net_pnl"], r["max_drawdown"]) == (0, 0.0, 0.0) for r in got)


def test_the_uniform_grid_has_its_cells():
    from millrace import queries_search

    assert len(queries_search.uniform().indices()) == 37_638
    assert len(queries_search.five([0.1, 0.2, 0.3, 0.4, 0.5]).indices()) == 7_020


@pytest.mark.parametrize("bins", [2, 3, 1024])
def test_quantiles(spark, bins, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", bins)
    r = random.Random(bins)
    rows = [(k % 3, r.choice([0.0, -1.5, r.random(), r.random() ** 9 * 1e9]), r.gauss(0, 1)) for k in range(900)] + [(7, 4.0, -0.0), (8, None, 1.0), (8, float("nan"), 2.0), (None, 1.0, 1.0), (None, 3.0, None)]
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(4)
    wanted = {"a": ("x", 0.0), "b": ("x", 0.1), "c": ("x", 0.5), "d": ("x", 0.9), "e": ("x", 1.0), "f": ("y", 0.25)}
    got = {x["g"]: x for x in quantiles.quantiles(df.where("g IS NOT NULL"), ["g"], wanted).collect()}
    for g in (0, 1, 2, 7):
        for name, (c, q) in wanted.items():
            own = [x[1 if c == "x" else 2] for x in rows if x[0] == g]
            assert got[g][name] == pytest.approx(np.quantile(own, q), rel=1e-12, abs=1e-12)
    assert got[8]["c"] is None and got[8]["f"] == 1.25
    whole = [x[2] for x in rows if x[2] is not None]
    assert quantiles.value_at(df, "y", [0.3, 0.77]) == pytest.approx(np.quantile(whole, [0.3, 0.77]))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "g int, x double")
    assert quantiles.quantiles(df, ["g"], {"a": ("x", 0.5)}).count() == 0
    with pytest.raises(ValueError, match="no values"):
        quantiles.value_at(df, "x", [0.5])
