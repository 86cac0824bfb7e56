"""Seven forecast variants over walk-forward folds, each through the same evaluation.

m0 coarse lookup; m1 fine lookup; m2 logistic on the price alone; m3 the same with older rows weighing
less; m4 with the snapshot's other features; m5 adds returns of a reference series up to the day
itself, which looks ahead on purpose and is never selected; m6 the same series a day late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import execution, joins, metrics, models, splits
from ..operators.execution import Rules
from ..sources import views
from ..sources.scratch import kept
from .grid_search import FOLDS, Fold

DAY = 86_400
STEPS = 5
HALF_LIFE_DAYS = 180.0
CLIP = (0.01, 0.99)
TOKEN = ["logit_mid_up", "mid_change", "spread_up", "spread_down", "dislocation"]
SERIES = ["return_path", "return_last", "volatility"]
LOGISTIC = {"m2": (TOKEN[:1], False), "m3": (TOKEN[:1], True), "m4": (TOKEN, True), "m5": (TOKEN + SERIES, True), "m6": (TOKEN + [f"lagged_{s}" for s in SERIES], True)}
USED = {f for features, _ in LOGISTIC.values() for f in features}
VARIANTS = ("m0", "m1", *LOGISTIC)
CONTROL = "m5"
RULES = Rules(minimum_net_edge=0.02, minimum_support=5, fee_decimals=4)


def with_features(spark: SparkSession, sf_dir: str, decisions: DataFrame) -> DataFrame:
    """Snapshot features, and path features of the daily mean order price up to the market's day and
    up to the day before."""
    day = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    series = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy((day - day % DAY).alias("t")).agg(F.avg("o_totalprice").alias("value"))
    d = models.price_features(decisions).withColumn("day", F.col("market_start_s") - F.col("market_start_s") % DAY)
    days = kept(d.select("day").distinct().withColumn("at", F.col("day")))
    for prefix, lag in (("", 0), ("lagged_", DAY)):
        f = joins.path_features(joins.lag_path(days, series, "day", "at", STEPS, DAY, lag), "day", STEPS)
        f = kept(f.select("day", *(F.col(c).alias(prefix + c) for c in SERIES)))
        d = d.join(F.broadcast(f), "day", "left")  # a row a day
    return d.drop("day")


def forecasts(spark: SparkSession, sf_dir: str, folds: list[Fold] | None = None) -> DataFrame:
    """Long format: each fold's validation markets under each variant, with their result. A market whose
    forecast is missing counts as an invalid snapshot. All folds and variants are fitted together, and evaluated in
    one plan. Books are read and walked once, before markets are repeated for each variant."""
    folds = folds or FOLDS
    ladder = views.depth(spark, sf_dir)
    walked = kept(execution.walked_decisions(views.markets(spark, sf_dir).join(views.tops(ladder), "condition_id"), ladder, RULES))
    d = with_features(spark, sf_dir, walked)
    windows = spark.createDataFrame([(f.fold_id, f.train_start_s, f.train_end_s, f.validation_start_s, f.validation_end_s) for f in folds], "fold_id int, train_start_s long, train_end_s long, validation_start_s long, validation_end_s long")
    train, test = (splits.folds(d, windows, "market_start_s", part) for part in ("train", "validation"))
    ends = F.create_map(*(F.lit(x) for f in folds for x in (f.fold_id, f.train_end_s)))[F.col("fold_id")]
    labelled = train.where(F.col("snapshot_valid") & F.col("outcome_up").isNotNull()).withColumn("weight", S.recency_weight((ends - F.col("market_start_s")) / DAY, HALF_LIFE_DAYS))

    def lookup(edges: list[float]) -> DataFrame:
        """A lookup model of each fold: a row per fold and bin."""
        return models.lookup_model(train, edges, by=["fold_id"])

    fine = S.uniform_edges(40)
    bins = lookup(fine).select("fold_id", F.col("bin").alias("fine_bin"), F.col("probability_up").alias("fine_probability"))
    test = test.withColumn("fine_bin", S.state_bin(F.col("mid_up"), fine)).join(F.broadcast(bins), ["fold_id", "fine_bin"], "left").drop("fine_bin")
    nothing = F.lit(None).cast("double")
    forecast = {"m0": nothing, "m1": F.col("fine_probability")}
    # Without enough complete training rows a fold has no model, and no forecast.
    fitted = models.fit_logistics(labelled, {name: (names, "weight" if decays else None) for name, (names, decays) in LOGISTIC.items()}, "outcome_up", group="fold_id", require=False)
    for name, (names, _) in LOGISTIC.items():
        forecast[name] = F.coalesce(nothing, *(F.when(F.col("fold_id") == k, models.logistic_probability(names, f, *CLIP)) for k, f in fitted[name].items()))
    test = kept(test.select(*(c for c in test.columns if c not in {"fine_probability", *USED}), *(f.alias(f"forecast_{name}") for name, f in forecast.items())))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("variant"), F.col(f"forecast_{name}").alias("forecast")) for name in VARIANTS)))
    long = test.select(*(c for c in test.columns if not c.startswith("forecast_")), each.alias("__v")).select("*", "__v.*").drop("__v")
    own = F.col("variant") == "m0"
    long = long.withColumn("snapshot_valid", F.col("snapshot_valid") & (own | F.col("forecast").isNotNull()))
    p = F.when(own, F.col("probability_up")).otherwise(F.col("forecast"))
    return execution.evaluate(long, None, lookup(list(RULES.edges)), RULES, probability=p, model_keys=("fold_id", "bin")).drop("forecast")


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast and money metrics of each variant; selectable leaves the look-ahead control out."""
    m = metrics.regime_metrics(forecasts(spark, sf_dir), ["variant"])
    return m.withColumn("selectable", F.col("variant") != CONTROL)
