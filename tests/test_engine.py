"""Execution, models, metrics and search on small literal cases and against direct versions."""

import math
import random

import pytest
from millrace.operators import audit, book, execution, joins, metrics, models, search, splits
from millrace.operators.execution import Rules
from millrace.plans import contracts, grid_search
from millrace.streaming import feeds
from pyspark.sql import functions as F

EDGES = (0.0, 0.5, 1.000001)
QUOTES = "condition_id string, market_start_s long, outcome_up double, previous_mid_up double, mid_up double, mid_down double, bid_up double, bid_down double, ask_up double, ask_down double, snapshot_valid boolean"


#: Three markets: bid of Up and Down, previous mid, asks of Up as (price, size).
MARKETS = {"a": (0.24, 0.71, 0.26, [(0.30, 8.0), (0.36, 50.0)]), "b": (0.27, 0.69, 0.28, [(0.31, 4.0), (0.33, 90.0)]), "c": (0.70, 0.26, 0.69, [(0.74, 30.0)])}


def batch(spark, outcomes=(1.0, 1.0, 0.0)):
    rows, depth = [], []
    for k, ((name, (up, down, before, asks)), outcome) in enumerate(zip(MARKETS.items(), outcomes, strict=True)):
        rows.append((name, k, outcome, before, up + 0.01, down + 0.01, up, down, up + 0.02, down + 0.02, True))
        depth += [(name, 0, p, n) for p, n in asks] + [(name, 1, down + 0.02, 25.0)]
    return spark.createDataFrame(rows, QUOTES), spark.createDataFrame(depth, "condition_id string, side int, price double, size double")


RULES = Rules(edges=EDGES, target=6.0)


def test_walk_fee_and_settlement(spark):
    quotes, depth = batch(spark)
    model = models.lookup_model(quotes, list(EDGES), 1.0, 1.0)
    a = quotes.where("condition_id = 'a'")
    r = execution.evaluate(a, depth, model, RULES).first()
    # 8 shares at 0.30 cost 2.4; the other 3.6 buy 10 at 0.36. Fees: 8 * .07 * .3 * .7 and 10 * .07 * .36 * .64.
    fee = 0.1176 + 0.16128
    assert r["filled"] and r["side"] == 0 and r["fill_shares"] == pytest.approx(18) and r["fill_cost"] == pytest.approx(6.0)
    assert r["platform_fee"] == pytest.approx(fee) and r["net_pnl"] == pytest.approx(18 - 6 - fee - 0.18)
    capped = execution.evaluate(a, depth, model, RULES.but(maximum_ask=0.35)).first()
    assert capped["fill_shares"] == pytest.approx(8.0) and capped["fill_cost"] == pytest.approx(2.4)


def test_each_market_pays_its_own_fee(spark):
    quotes, depth = batch(spark)
    model = models.lookup_model(quotes, list(EDGES), 1.0, 1.0)
    rate = F.when(F.col("condition_id") == "a", 0.0).when(F.col("condition_id") == "b", 0.14)
    got = {r["condition_id"]: r["platform_fee"] for r in execution.evaluate(quotes.withColumn("fee_rate", rate), depth, model, RULES).collect() if r["filled"]}
    # b: 4 at 0.31 cost 1.24, 4.76 / 0.33 shares more, at twice the usual rate.
    assert got["a"] == 0.0 and got["b"] == pytest.approx(round(4 * 0.14 * 0.31 * 0.69, 5) + round(4.76 / 0.33 * 0.14 * 0.33 * 0.67, 5))


def test_future_outcome_does_not_change_a_decision(spark):
    quotes, depth = batch(spark)
    model = models.lookup_model(quotes, list(EDGES), 1.0, 1.0)
    other, _ = batch(spark, (0.0, 0.0, 1.0))
    pick = lambda q: [tuple(x) for x in execution.evaluate(q, depth, model, RULES).orderBy("condition_id").select("side", "status", "fill_shares").collect()]
    assert pick(quotes) == pick(other)


def test_gates_in_order(spark):
    quotes, depth = batch(spark)
    model = models.lookup_model(quotes, list(EDGES), 1.0, 1.0)
    code = lambda **c: execution.evaluate(quotes.where("condition_id = 'a'"), depth, model, RULES.but(**c)).first()["status"]
    assert [code(minimum_support=99, maximum_ask=0.1), code(maximum_ask=0.1), code(minimum_persistence=1.0, minimum_net_edge=9.0), code(minimum_net_edge=9.0), code(require_favorite=True), code()] == [2, 3, 4, 5, 8, 0]
    invalid = quotes.withColumn("snapshot_valid", F.lit(False))
    assert execution.evaluate(invalid, depth, model, RULES.but(minimum_support=99)).first()["status"] == 1


def test_transitions_without_counts_are_uniform(spark):
    d = spark.createDataFrame([(0, 0), (0, 1)], "a int, b int")
    m = {(r["prev_bin"], r["bin"]): r["p"] for r in models.transitions(d, F.col("a"), F.col("b"), 3).collect()}
    assert len(m) == 9 and m[2, 1] == pytest.approx(1 / 3) and m[0, 0] == pytest.approx(2 / 5)


def test_logistic_is_monotone(spark):
    d = spark.createDataFrame([(x, float(x > 0)) for x in (-2.0, -1.0, -0.5, 0.5, 1.0, 2.0)], "x double, y double")
    fitted = models.fit_logistic(d, ["x"], "y")[0]
    p = [r["probability_up"] for r in models.predict_logistic(d, ["x"], fitted).orderBy("x").collect()]
    assert p == sorted(p) and p[0] < 0.1 and p[-1] > 0.9


def test_running_over_buckets(spark):
    r = random.Random(1)
    rows = [(t, k, r.uniform(-3, 3)) for k, t in enumerate(sorted(r.randrange(10) * 40_000 for _ in range(200)))]
    d = metrics.running(spark.createDataFrame(rows, "t long, id long, v double"), "v", "t", "id").orderBy("t", "id").collect()
    cum = peak = 0.0
    for row, (_, _, v) in zip(d, rows, strict=True):
        cum += v
        peak = max(peak, cum)
        assert row["cum"] == pytest.approx(cum) and row["drawdown"] == pytest.approx(peak - cum)


def test_ledger(spark):
    d = spark.createDataFrame([(0, 0, 10.0, 10.0), (1, 1, -30.0, 11.0), (2, 2, 5.0, 8.0)], "t long, id long, pnl double, outlay double")
    rows = metrics.ledger(d, "pnl", "outlay", "t", "id", 100.0).orderBy("t").collect()
    assert [r["capital_before"] for r in rows] == [100.0, 110.0, 80.0] and [r["drawdown"] for r in rows] == [0.0, 30.0, 25.0]


def test_rolling_sum_with_ties(spark):
    rows = [(0, 1, 1.0), (0, 2, 2.0), (86_400, 3, 4.0), (86_400, 4, 8.0), (86_401, 5, 16.0)]
    d = metrics.rolling_time_sum(spark.createDataFrame([(0, *x) for x in rows], "g int, t long, id long, v double"), "v", "t", "id", 86_400, ["g"])
    assert [r["rolling"] for r in d.orderBy("id").collect()] == [1.0, 3.0, 7.0, 15.0, 28.0]


def test_split_keeps_equal_times_together(spark):
    d = spark.createDataFrame([(k, t) for k, t in enumerate([1, 1, 2, 2, 3, 3, 4, 4, 5, 5])], "id long, t long")
    rows = splits.atomic(d, "t").groupBy("t").agg(F.collect_set("split").alias("s")).orderBy("t").collect()
    assert [r["s"] for r in rows] == [["train"]] * 3 + [["validation"]] + [["test"]]


def test_neighbours_and_medians(spark):
    rows = [(0, 0, 4.0, 2, 3), (1, 0, 3.0, 3, 3), (2, 0, -1.0, 2, 3)]
    d = spark.createDataFrame([(k, k, 0, 0, 0, p, p, n, m) for k, (_, _, p, n, m) in enumerate(rows)], "cell_id long, i0 int, i1 int, i2 int, i3 int, net_pnl double, stress_pnl double, positive_folds long, folds long")
    f = search.neighbour_floor(d).orderBy("cell_id").collect()
    assert [r["floor_pnl"] for r in f] == [3.0, -1.0, 3.0] and [r["floor_folds"] for r in f] == [3, 2, 3]
    p = search.plateau(d).orderBy("cell_id").collect()
    assert [r["members"] for r in p] == [2, 3, 2] and [r["median_pnl"] for r in p] == [3.5, 3.0, 1.0]


def test_grid_counts_and_lattice(spark):
    assert grid_search.GRID.cells(spark).count() == grid_search.GRID.count()
    r = random.Random(2)
    g = search.Grid((0.1, 0.3), (0.2, 0.5, 0.9), (0.0, 0.5), (0.0, 0.1))
    rows = [(k, k, True, r.random(), r.random(), r.random(), r.uniform(-0.1, 0.2), r.uniform(-1, 1), r.uniform(-1, 1), k < 25) for k in range(50)]
    d = spark.createDataFrame(rows, "condition_id long, market_start_s long, filled boolean, signal_ask double, fill_vwap double, persistence double, net_edge double, net_pnl double, stress_pnl double, first_half boolean")
    for c in search.grid_metrics(d, g, []).collect():
        inside = [x for x in rows if c["minimum_ask"] <= x[3] <= c["maximum_ask"] and x[4] <= c["maximum_ask"] and x[5] >= c["minimum_persistence"] and x[6] >= c["minimum_edge"]]
        assert c["fills"] == len(inside) and c["net_pnl"] == pytest.approx(sum(x[7] for x in inside)) and c["half1_pnl"] == pytest.approx(sum(x[7] for x in inside if x[9]))


def test_folds_must_not_look_ahead():
    with pytest.raises(grid_search.FoldError):
        grid_search.check_folds([grid_search.Fold(0, 0, 20, 10, 30)])
    with pytest.raises(grid_search.FoldError):
        grid_search.check_folds([grid_search.Fold(0, 0, 10, 10, 20)], holdout_start_s=15)


def test_asof_is_causal(spark):
    ticks = spark.createDataFrame([(1, 10, 1, 5.0), (1, 20, 2, 6.0), (1, 20, 3, 7.0), (1, 30, 4, 9.0)], "k int, t long, id long, v double")
    r = joins.asof_agg(ticks, ["k"], ["t", "id"], ["v"], {"b": F.lit(25)}, {"f": F.lit(21)}).first()
    assert r["b"]["v"] == 7.0 and r["f"]["v"] == 9.0


def test_path_features_do_not_see_later_points(spark):
    s = lambda last: spark.createDataFrame([(60 * k, v) for k, v in enumerate([100.0, 101.0, 100.5, 102.0, 103.0, last], 1)], "t long, value double")
    d = spark.createDataFrame([(1, 300)], "key long, at long")
    row = lambda last: tuple(joins.path_features(joins.lag_path(d, s(last), "key", "at", 5, 60), "key", 5).first())
    assert row(999.0) == row(1.0) and row(1.0)[1] == pytest.approx(math.log(103 / 100))


def test_ledger_audit(spark):
    rows = [("x", "c1", 10, "TRADE", "BUY", 5.0), ("x", "c1", 20, "TRADE", "BUY", 4.0), ("x", "c1", 30, "REDEEM", "", 12.0), ("x", "c2", 40, "TRADE", "BUY", 3.0), ("x", "c2", 45, "REDEEM", "", 12.0), ("x", None, 50, "MAKER_REBATE", "", 1.0)]
    d = spark.createDataFrame(rows, "account_id string, condition_id string, t long, activity_type string, side string, usdc_size double")
    assert sorted(r["pnl"] for r in audit.settled(d).collect()) == [3.0, 9.0]
    assert audit.with_cash(d).agg(F.sum("reward_cash")).first()[0] == 1.0
    assert audit.exact_rows(d.unionByName(d), d.columns).count() == 6


def test_saturated_spans_are_halved():
    rows = [(t, f"c{k}") for k, t in enumerate([1, 1, 2, 2, 3])]
    fetch = lambda a, b: [x for x in rows if a <= x[0] <= b][:3]
    assert contracts.split_saturated(fetch, 1, 4, 3) == rows


def test_book_hints_and_depth(spark):
    r = random.Random(3)
    kinds = ["snapshot", "bid", "bid", "bid", "ask", "ask", "best_bid", "best_ask"]
    rows = [(tok, 100 + k, k, r.choice(kinds), r.randrange(1, 9) / 10, r.randrange(3)) for tok in range(8) for k in range(60)]
    d = spark.createDataFrame(rows, "token long, t long, event_id long, kind string, price double, size long")
    have = {}
    for x in book.depth_at(d, 1000).collect():
        have.setdefault(x["token"], {"bid": {}, "ask": {}})[x["side"]][x["price"]] = x["size"]
    for tok in range(8):
        b = book.replay((k, p, s) for t, _, _, k, p, s in rows if t == tok)
        assert have.get(tok, {"bid": {}, "ask": {}}) == b.levels
    folded = {x["token"]: (x["best_bid"], x["best_ask"], x["n_bids"], x["n_asks"]) for x in book.fold(d).collect()}
    for tok in range(8):
        row = book.replay((k, p, s) for t, _, _, k, p, s in rows if t == tok).row()
        same = folded[tok]
        assert [None if v is None or math.isnan(v) else v for v in same] == list(row[:4])


def test_stream_equals_batch(spark):
    at = "/root/testdata/sf0.001"
    from millrace.sources import views

    batch_rows = {tuple(str(v) for v in r) for r in book.fold(views.book_events(spark, at)).collect()}
    live = feeds.drain(feeds.books(feeds.event_stream(spark, at)), "update", "token")
    assert {tuple(str(v) for v in r) for r in live.select("token", "best_bid", "best_ask", "n_bids", "n_asks", "ignored", "crossed").collect()} == batch_rows


def test_contracts(tmp_path):
    import dataclasses

    @dataclasses.dataclass(frozen=True)
    class C:
        a: int
        b: tuple

    assert contracts.load_config(C, '{"a": 1, "b": [2]}') == C(1, (2,))
    with pytest.raises(contracts.ContractError):
        contracts.load_config(C, '{"a": 1}')
    mark = str(tmp_path / "opened")
    contracts.open_holdout_once(mark, {"x": "1"}, {"x": "1"})
    with pytest.raises(contracts.ContractError):
        contracts.open_holdout_once(mark, {"x": "1"}, {"x": "1"})
    assert contracts.primary_gate({"fills": 5, "pnl": -1}, {"pnl": (">", 0)}, 3) == ("fail", ["pnl"])
    assert contracts.primary_gate({"fills": 1, "pnl": 9}, {"pnl": (">", 0)}, 3)[0] == "inconclusive"
