"""Invariants fail where they are broken; early decisions at the bounds of staleness."""

import math

import pytest
from millrace.operators import execution, models
from millrace.plans import early, grid_search, invariants
from millrace.plans.invariants import InvariantError
from millrace.sources import views
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stress_that_improves_trades_fails_the_search(spark):
    with pytest.raises(InvariantError, match="stress"):
        grid_search.fold_results(spark, SF, extra=-0.01)
    assert grid_search.fold_results(spark, SF).count() > 0


def test_gates_that_are_not_the_fills_fail(spark):
    ladder = views.depth(spark, SF)
    decisions = views.decisions(spark, SF)
    model = models.lookup_model(decisions, list(grid_search.OPEN.edges))
    rules = execution.Rules(minimum_net_edge=0.02, minimum_support=5, require_favorite=True)
    d = execution.evaluate(decisions, ladder, model, rules, show_gates=True)
    kept = invariants.upheld(d, "all gates", gates=invariants.all_gates())
    assert 0 < kept.where("filled").count() < kept.count()
    with pytest.raises(InvariantError, match="'gates': 1"):
        one = kept.where("filled").limit(1).select("condition_id").withColumn("off", F.lit(True))
        invariants.upheld(kept.join(one, "condition_id", "left").withColumn("gate_range", F.col("gate_range") & F.col("off").isNull()), "all gates", gates=invariants.all_gates())


def test_upheld_keeps_the_rows_and_counts_nulls_as_broken(spark):
    df = spark.createDataFrame([(1, True), (2, True)], "a int, ok boolean")
    assert sorted(r["a"] for r in invariants.upheld(df, "rows", ok=F.col("ok")).collect()) == [1, 2]
    with pytest.raises(InvariantError, match="'ok': 1"):
        invariants.upheld(df.unionByName(spark.createDataFrame([(3, None)], df.schema)), "rows", ok=F.col("ok"))
    assert invariants.upheld(df.where("a > 5"), "rows", ok=F.col("ok")).count() == 0


def test_a_market_twice_at_one_time_has_no_order(spark):
    from millrace.operators import lattice

    df = spark.createDataFrame([(1, 7, 100, 0.5, 1.0), (1, 7, 100, 0.5, 2.0)], "fold int, condition_id long, market_start_s long, ask double, net_pnl double")
    grid = lattice.Lattice((lattice.Axis("lo", "ask", (0.1,)),))
    with pytest.raises(Exception, match="not strict"):
        lattice.drawdowns(df, ["fold"], grid, 1000).collect()


TICK = "market_id string, market_start_s long, ts long, row_id long, bid_up double, ask_up double, bid_down double, ask_down double, size_up double, size_down double"


def tick(market, offset, row=0, bid=0.4, ask=0.5, down=(0.5, 0.6), sizes=(100.0, 100.0)):
    return (market, 1000, 1_000_000 + offset, row, bid, ask, *down, *sizes)


def good(market, previous=240_000, current=270_000, execution_at=271_000, **change):
    return [tick(market, previous), tick(market, current, **change), tick(market, execution_at)]


def test_quotes_at_the_bounds(spark):
    rows = good("exact") + good("second", 239_000, 269_000, 272_000) + good("two before", 238_000) + good("two after", execution_at=273_000)
    rows += good("just off", previous=238_999) + good("late previous", previous=240_001) + good("crossed", bid=0.6) + good("above", ask=1.01) + good("none", ask=None)
    rows += [*good("small")[:2], tick("small", 271_000, sizes=(19.9, 20.0))] + good("nan", bid=math.nan)
    rows += [*good("tie"), tick("tie", 270_000, row=5, bid=0.3, ask=0.44)]
    labels = spark.createDataFrame([(m, f"c-{m}", 1.0) for m in {r[0] for r in rows}], "market_id string, condition_id string, outcome_up double")
    got = {r["market_id"]: r for r in early.batch(spark.createDataFrame(rows, TICK), labels).collect()}
    assert {m for m, r in got.items() if r["snapshot_valid"]} == {"exact", "second", "small", "tie"}
    assert {m for m, r in got.items() if not r["timely"]} == {"two before", "two after", "just off", "late previous", "none", "nan"}
    assert (got["small"]["size_up"], got["small"]["size_down"]) == (0.0, 20.0)
    assert got["tie"]["bid_up"] == 0.3 and got["late previous"]["previous_mid_up"] is None


def test_early_batches_are_whole(spark):
    labels = spark.createDataFrame([("a", "c", 1.0)], "market_id string, condition_id string, outcome_up double")
    declared = spark.createDataFrame([("a",), ("b",)], "market_id string")
    d = early.batch(spark.createDataFrame(good("a"), TICK), labels)
    with pytest.raises(early.CoverageError, match="1 of 2"):
        early.checked(d, declared)
    kept, missing = early.checked(d, declared, 0.5)
    assert [r["market_id"] for r in missing.collect()] == ["b"] and kept.count() == 1
    with pytest.raises(early.CoverageError, match="no outcome"):
        early.checked(early.batch(spark.createDataFrame(good("a") + good("b"), TICK), labels), declared)
    with pytest.raises(early.CoverageError, match="more than once"):
        early.checked(early.batch(spark.createDataFrame(good("a"), TICK), labels.unionByName(labels)), declared)
    empty = early.batch(spark.createDataFrame([], TICK), labels)
    assert early.checked(empty, declared.where("false"))[0].count() == 0


def test_upsert_takes_the_old_table_back_and_picks_the_greatest_row(spark, tmp_path):
    from millrace.sources import sinks

    at = f"{tmp_path}/t"
    row = lambda *r: spark.createDataFrame(list(r), "k int, v int, w string")
    get = lambda: sorted(tuple(x) for x in spark.read.parquet(at).collect())
    sinks.upsert(row((1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, 1, "x")), at, ["k"])
    assert get() == [(1, 7, "c"), (2, 1, "x")]
    (tmp_path / "t").rename(tmp_path / "t.old")  # a job that ended between the renames
    sinks.upsert(row((2, 9, "y"), (3, 0, "z")), at, ["k"])
    assert get() == [(1, 7, "c"), (2, 9, "y"), (3, 0, "z")] and not (tmp_path / "t.old").exists()
