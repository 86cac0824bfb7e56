"""Literal cases of the scalar functions."""

import math

from millrace.functions import scalars as S
from pyspark.sql import functions as F


def one(spark, expr, **columns):
    d = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())) if columns else spark.range(1)
    return d.select(expr.alias("v")).first()["v"]


def test_bins_are_closed_on_the_right(spark):
    edges = S.uniform_edges(10)
    for x, want in ((0.0, 0), (0.1, 0), (0.1000001, 1), (0.5, 4), (1.0, 9), (float("nan"), 9), (None, 9)):
        assert one(spark, S.state_bin(F.col("x").cast("double"), edges), x=x) == want


def test_fees(spark):
    assert one(spark, S.platform_fee(F.lit(100.0), F.lit(0.5), 0.07, 5)) == 1.75
    assert one(spark, S.platform_fee(F.lit(100.0), F.lit(0.5), 0.25, 5, 2.0)) == 1.5625
    assert one(spark, S.round_half_even(F.lit(1.00005), 4)) == 1.0001


def test_profit_factor(spark):
    f = lambda p, q: one(spark, S.profit_factor(F.lit(p), F.lit(q)))
    assert f(4.0, 2.0) == 2.0 and f(1.0, 0.0) == math.inf and f(0.0, 0.0) == 0.0
    assert one(spark, S.ratio(F.lit(1.0), F.lit(0.0))) is None


def test_prices_and_exact_numbers(spark):
    for text, want in (("0.42", 4200), ("0.12345", None), ("1", 10000), ("1.5", None), ("0.5000", 5000)):
        assert one(spark, S.price_index(F.col("x")), x=text) == want
    assert str(one(spark, S.e18(F.lit("63000500000000000000001")))) == "63000.500000000000000001"
    assert str(one(spark, S.complement(F.lit("0.3300").cast("decimal(5,4)")))) == "0.6700"
    assert one(spark, S.tick_size(F.lit("0.010"))) == "0.01" and one(spark, S.tick_size(F.lit("0.005"))) is None


def test_times(spark):
    assert one(spark, S.epoch_seconds("x"), x=1_700_000_000_000) == 1_700_000_000
    assert one(spark, S.epoch_seconds("x"), x=1_700_000_000_000_000) == 1_700_000_000
    assert one(spark, S.ceil_seconds("x"), x=1001) == 2
    assert one(spark, S.iso_seconds(F.lit("2024-01-01T00:00:00Z"))) == 1_704_067_200
    assert one(spark, S.iso_seconds(F.lit("2024-01-01T00:00:00"))) is None
    assert one(spark, S.hour_key(F.lit(1_704_067_200))) == "2024-01-01T00"


def test_json(spark):
    assert [tuple(x) for x in one(spark, S.levels(F.lit('[["0.40","2"],["0.42","x"]]')))] == [(0.4, 2.0), (0.42, None)]
    assert one(spark, S.json_array(F.lit('["Up","Down"]'))) == ["Up", "Down"]
    kinds = {
        '{"bids":[],"asks":[],"price_changes":[]}': "book", '{"bids":[]}': "unknown", '{"price_changes":null}': "price_change", '{"priceChanges":[]}': "price_change", '{"newTickSize":"0.01"}': "tick_size_change",
        '{"winningTokenId":"1"}': "market_resolved", '{"best_bid":"1","best_ask":"1","spread":"0"}': "best_bid_ask", '{"best_bid":"1","best_ask":"1"}': "unknown", '{"price":"1","side":"BUY"}': "last_trade_price",
        '{"event_type":"","price":"1","side":"BUY"}': "last_trade_price", '{"event_type":"book","price":"1"}': "book", '{"topic":"market","type":"book","payload":{"price_changes":[]}}': "book",
        '{"topic":"market","payload":{"bids":[],"asks":[]}}': "unknown", '{"topic":"other","type":"book","payload":{}}': "unknown", '{"topic":"market","type":"book","payload":[1]}': "unknown",
    }
    for message, kind in kinds.items():
        assert one(spark, S.event_type(F.lit(message))) == kind, message
    assert one(spark, S.fee_per_share(F.lit(0.5), 0.25, F.lit(2.0))) == 0.015625
    assert one(spark, S.alias(F.lit('{"tokenId":"7"}'), "asset_id", "tokenId")) == "7"
    assert one(spark, S.number(F.lit("nan"))) == 0.0 and one(spark, S.number(F.lit("x"), None)) is None


def test_titles(spark):
    kind = lambda t: (one(spark, S.classify_asset(F.lit(t))), one(spark, S.classify_duration(F.lit(t))))
    assert kind("Bitcoin up or down 15m") == ("BTC", "15m")
    assert kind("Solstice hourly") == ("OTHER", "1h")
    assert kind("eth-5m-123") == ("ETH", "5m")
