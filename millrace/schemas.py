"""Schemas of the stored tables; readers are given these and never infer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = "array<struct<price:double,size:double>>"
DECISION = (
    "condition_id string, asset string, market_start_s bigint, market_end_s bigint, decision_s bigint, previous_s bigint, outcome_up double, n_ticks bigint, "
    "previous_mid_up double, mid_up double, mid_down double, bid_up double, bid_down double, ask_up double, ask_down double, "
    f"depth_up {LEVELS}, depth_down {LEVELS}, snapshot_valid boolean, fee_rate double, label_source string"
)
TICK = "condition_id string, t bigint, bid_up double, ask_up double, bid_down double, ask_down double, size_ask_up double, size_ask_down double"
BOOK_EVENT = "condition_id string, receive_timestamp_ms bigint, source_timestamp_ms bigint, event_type string, asset_id string, bids string, asks string, price string, size string, side string, best_bid string, best_ask string"
UNIVERSE = "condition_id string, asset string, duration string, market_start_ms bigint, outcome_up double, fee_rate double"
ACTIVITY = "account_id string, row_hash string, timestamp bigint, activity_type string, side string, price double, size double, usdc_size double, condition_id string, asset string, outcome string, title string"
KLINE = "open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, quote_volume double, trades bigint, taker_base double, taker_quote double, ignored string"
FRAME = "sequence bigint, wall_ns bigint, monotonic_ns bigint, direction string, connection int, raw binary"
FOLD = "fold_id int, train_start_s bigint, train_end_s bigint, validation_start_s bigint, validation_end_s bigint"

#: Result codes of the gate cascade, in order. Fixed values.
STATUS = ("filled", "data_invalid", "insufficient_support", "ask_out_of_range", "low_persistence", "edge_below_threshold", "no_liquidity", "side_tie", "not_market_favorite")


def require_columns(df: DataFrame, columns: list[str], source: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{source} lacks columns {missing}")
    return df


def violations(df: DataFrame, **rules) -> DataFrame:
    """One row: how many rows break each rule (a boolean column expression; NULL counts as broken)."""
    return df.agg(*(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))


def decision_rules() -> dict:
    """The contract of a decision snapshot, one rule each."""
    return {
        "ids_present": F.col("condition_id").isNotNull(),
        "times_ordered": (F.col("market_start_s") <= F.col("previous_s")) & (F.col("previous_s") <= F.col("decision_s")) & (F.col("decision_s") <= F.col("market_end_s")),
        "outcome_binary": F.col("outcome_up").isNull() | F.col("outcome_up").isin(0.0, 1.0),
        "quotes_when_valid": ~F.col("snapshot_valid") | (F.col("ask_up").isNotNull() & F.col("ask_down").isNotNull()),
    }
