"""The seven variants against single evaluations of their parts."""

import pytest
from millrace.operators import execution, joins, models
from millrace.plans import grid_search, regimes
from millrace.sources import views
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def forecasts(spark):
    from millrace.sources.scratch import kept

    return kept(regimes.forecasts(spark, SF))


def test_the_lookup_variants_are_those_of_single_folds(spark, forecasts):
    ladder = views.depth(spark, SF)
    decisions = views.markets(spark, SF).join(views.tops(ladder), "condition_id")
    seen, cells = 0, ["condition_id", "status", "probability", "side", "net_pnl"]
    for f in grid_search.FOLDS:
        within = lambda d, a, b: d.where((F.col("market_start_s") >= a) & (F.col("market_start_s") < b))
        model = models.lookup_model(within(decisions, f.train_start_s, f.train_end_s), list(regimes.RULES.edges))
        one = execution.evaluate(within(decisions, f.validation_start_s, f.validation_end_s), ladder, model, regimes.RULES)
        rounded = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select(*cells).where("probability IS NOT NULL").collect())
        got = rounded(forecasts.where((F.col("variant") == "m0") & (F.col("fold_id") == f.fold_id)))
        assert got == rounded(one)
        seen += len(got)
    assert seen


def test_every_variant_sees_every_market_and_missing_forecasts_are_invalid(forecasts):
    n = {r["variant"]: (r["n"], r["bad"]) for r in forecasts.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("status") != 1) & F.col("probability").isNull() & F.col("filled")).alias("bad")).collect()}
    assert set(n) == set(regimes.VARIANTS) and len({a for a, _ in n.values()}) == 1 and all(b == 0 for _, b in n.values())
    clipped = forecasts.where(F.col("variant").isin(*regimes.LOGISTIC) & F.col("filled")).agg(F.min("probability"), F.max("probability")).first()
    assert clipped[0] is None or (clipped[0] >= regimes.CLIP[0] - 1e-12 and clipped[1] <= regimes.CLIP[1] + 1e-12)


def test_only_the_control_is_left_out(spark):
    got = {r["variant"]: r["selectable"] for r in regimes.comparison(spark, SF).collect()}
    assert {v for v, ok in got.items() if not ok} == {regimes.CONTROL} and set(got) == set(regimes.VARIANTS)


def test_the_lagged_path_does_not_look_ahead(spark):
    series = spark.createDataFrame([(86_400 * k, float(100 + k * k)) for k in range(12)], "t long, value double")
    at = spark.createDataFrame([(1, 86_400 * 9)], "day long, at long")
    now, late = (joins.path_features(joins.lag_path(at, series, "day", "at", 5, 86_400, lag), "day", 5).first() for lag in (0, 86_400))
    changed = series.where(F.col("t") < 86_400 * 9).unionByName(spark.createDataFrame([(86_400 * 9, 1.0)], series.schema))
    again = joins.path_features(joins.lag_path(at, changed, "day", "at", 5, 86_400, 86_400), "day", 5).first()
    assert late == again and now != late


def test_keyed_lookup_models_are_the_single_ones(spark):
    d = views.decisions(spark, SF).withColumn("g", F.col("condition_id") % 3)
    edges = list(regimes.RULES.edges)
    keyed = sorted(tuple(r) for r in models.lookup_model(d, edges, by=["g"]).select("g", "bin", "probability_up", "support", "persistence").collect())
    single = sorted((g, *r) for g in range(3) for r in models.lookup_model(d.where(F.col("g") == g), edges).select("bin", "probability_up", "support", "persistence").collect())
    assert keyed == single
