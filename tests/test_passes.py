"""How often rows are read, and how far they are spread."""

import random

import numpy as np
import pytest
from millrace.functions import scalars as S
from millrace.operators import lattice, models
from millrace.operators.lattice import Axis, Lattice
from millrace.sources import views
from pyspark.sql import functions as F


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


def test_a_lookup_model_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    rows = spark.sparkContext.parallelize([(True, float(k % 2), (k % 10) / 10, (k % 7) / 7) for k in range(60)], 2).map(counted)
    d = spark.createDataFrame(rows, "snapshot_valid boolean, outcome_up double, previous_mid_up double, mid_up double")
    assert sum(r["support"] for r in models.lookup_model(d, S.uniform_edges(10)).collect()) == 60
    assert seen.value == 60


def test_variants_are_fitted_in_the_same_passes(spark):
    r = random.Random(5)
    rows = [(k % 2, *(x := [r.gauss(0, 1) for _ in range(3)]), float(r.random() < 1 / (1 + np.exp(-x[0]))), r.choice([1.0, 2.0, None])) for k in range(400)]
    d = spark.createDataFrame(rows, "g int, a double, b double, c double, y double, w double")
    variants = {"one": (["a"], None), "two": (["a", "b"], "w"), "three": (["c", "b", "a"], None)}
    (got, together), (_, alone) = (jobs(spark, n, lambda v=v: models.fit_logistics(d, v, "y", group="g")) for n, v in (("all", variants), ("single", {"two": variants["two"]})))
    assert together <= alone + 4
    for name, (features, weight) in variants.items():
        single = models.fit_logistic(d, features, "y", weight, group="g")
        assert set(got[name]) == set(single) == {0, 1}
        for g, (mean, scale, beta) in single.items():
            assert np.allclose(np.concatenate([mean, scale, beta]), np.concatenate(got[name][g]), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("at", [False, True])
def test_many_edges_are_counted_like_few(spark, at):
    edges = [k / 40 for k in range(1, 41)]
    values = [None, float("inf"), float("-inf"), -1.0, 0.0, *edges, 0.3000001, 2.0]
    d = spark.createDataFrame([(v,) for v in values], "v double").select("v", S.passed(F.col("v"), edges, at).alias("n"))
    for r in d.collect():
        assert r["n"] == (0 if r["v"] is None else sum(r["v"] >= e if at else r["v"] > e for e in edges))


def test_one_bucket_of_trades_is_walked_in_pieces(spark, monkeypatch):
    grid = Lattice((Axis("lo", "ask", (0.1, 0.3, 0.5)), Axis("edge", "edge", (0.0, 0.1))))
    calls, stretch = spark.sparkContext.accumulator(0), lattice._stretch

    def counted(*a):
        calls.add(1)
        stretch(*a)

    monkeypatch.setattr(lattice, "_stretch", counted)
    r = random.Random(2)
    rows = [(1, k, 7, r.random(), r.random() - 0.3, r.gauss(0, 1)) for k in range(500)]
    d = spark.createDataFrame(rows, "fold int, condition_id long, market_start_s long, ask double, edge double, net_pnl double")
    got = {x["cell_id"]: x["max_drawdown"] for x in lattice.drawdowns(d, ["fold"], grid, 1000).collect()}
    cum = peak = fall = 0.0
    for x in rows:
        if x[3] >= 0.1 and x[4] >= 0.0:
            cum += x[5]
            peak = max(peak, cum)
            fall = max(fall, peak - cum)
    assert got[0] == pytest.approx(fall) and calls.value > 4


def test_cells_that_pass_the_same_trades_are_one_class():
    grid = Lattice((Axis("lo", "ask", tuple(range(20))), Axis("hi", "high", tuple(range(15)), most=True), Axis("edge", "edge", tuple(range(9)))), ("lo", "hi"))
    cells, places = grid.indices(), np.random.default_rng(3).integers(0, [20, 15, 9], (6, 3))
    passing, of = lattice._classes(cells, places, [False, True, False])
    direct = (cells[:, 0] <= places[:, :1]) & (cells[:, 1] >= places[:, 1:2]) & (cells[:, 2] <= places[:, 2:])
    assert (passing[:, of] == direct).all() and passing.shape[1] <= 64 < len(cells)


def test_books_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = sorted(tuple(r) for r in views.depth(spark, sf).collect())
    monkeypatch.setattr(views, "ROWS", 500)
    d = views.depth(spark, sf).withColumn("task", F.spark_partition_id())
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert d.rdd.getNumPartitions() == -(-lines // 500) > spark.sparkContext.defaultParallelism
    assert d.groupBy("condition_id").agg(F.countDistinct("task").alias("n")).agg(F.max("n")).first()[0] == 1
    assert sorted(tuple(r) for r in d.drop("task").collect()) == whole
