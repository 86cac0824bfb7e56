"""A whole backtest: split in time, fit on the first part, evaluate all parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import execution, metrics, models, splits
from ..operators.execution import Rules
from ..sources import views
from ..sources.scratch import kept

RULES = Rules(minimum_net_edge=0.02, minimum_support=5)


def evaluated(spark: SparkSession, sf_dir: str, rules: Rules = RULES) -> DataFrame:
    """Every market of the sample views with its split and result; the model sees train rows only. Books are read and
    walked once."""
    ladder = views.depth(spark, sf_dir)
    walked = kept(execution.walked_decisions(views.markets(spark, sf_dir).join(views.tops(ladder), "condition_id"), ladder, rules))
    decisions = splits.atomic(walked, "market_start_s")
    model = models.lookup_model(decisions.where(F.col("split") == "train"), list(rules.edges))
    return execution.evaluate(decisions, None, model, rules)


def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(evaluated(spark, sf_dir), ["split"])


#: The three probability models of a screening run and its costs.
COSTS = {"base": 0.01, "stress": 0.02}


def variants(spark: SparkSession, sf_dir: str, rules: Rules = RULES) -> DataFrame:
    """Long format: each market under each model variant and cost scenario."""
    ladder = views.depth(spark, sf_dir)
    decisions = splits.atomic(views.markets(spark, sf_dir).join(views.tops(ladder), "condition_id"), "market_start_s")
    train, test = decisions.where(F.col("split") == "train"), decisions.where(F.col("split") == "test")
    edges = list(rules.edges)
    model = models.lookup_model(train, edges)
    valid = train.where(F.col("snapshot_valid") & F.col("outcome_up").between(0, 1))
    from ..functions import scalars as S

    matrix = models.transitions(valid, S.state_bin(F.col("previous_mid_up"), edges), S.state_bin(F.col("mid_up"), edges), len(edges) - 1)
    literal = model.drop("probability_up").join(models.literal_one_step(matrix, edges).withColumnRenamed("expected_mid", "probability_up"), "bin")
    favorite = F.when(F.col("mid_down") > F.col("mid_up"), 1).otherwise(0)
    # One walk for all: the ladder's use depends on neither model nor gates nor extra cost.
    test = kept(execution.walked_decisions(test, ladder, rules))
    out = None
    for cost, extra in COSTS.items():
        r = rules.but(extra_cost=extra)
        runs = {
            "terminal_lookup": execution.evaluate(test, None, model, r),
            "literal_one_step": execution.evaluate(test, None, literal, r),
            "range_only": execution.evaluate(test, None, model, r.but(support_gate=False, persistence_gate=False, edge_gate=False), forced_side=favorite),
        }
        for name, d in runs.items():
            d = d.withColumns({"variant": F.lit(name), "cost": F.lit(cost)})
            out = d if out is None else out.unionByName(d)
    return out
